"""Token pieces and best-fit packing into fixed-length sequences.

Packing is bulk-synchronous best-fit. Pieces of more than half a sequence open one each, as no two of them fit
together. Then rounds follow, each over all pieces and gaps that are left. Both are put in the order of their size,
largest first, gaps before pieces: a gap goes on a stack and a piece takes the gap on top, the smallest that is left
for it. A gap's or piece's height on that stack comes from counts by size and its rank among its equals, which
settles who of them is served; the gap below a piece is then its predecessor among those of the same height. So a
round is a rank inside each size and a sweep inside each height, both spread over the cluster; only the counts by
size (at most ``max_len`` of gaps and of pieces) are ordered in one place. Of the pieces that found no gap the
largest open new sequences, ``open_share`` of those that they need together; gaps shrink, and the next round follows
until no piece is left.

Defined cases: a null text is the empty text (one piece that holds the end token only); an empty table gives an
empty table; repeated rows are packed as often as they occur; other columns are ignored. Documents longer than
``max_len`` are cut so that only the first piece is shorter, however long they are. Sequence ids are unique, not
consecutive; among pieces of one length any may be served first, which changes no number of sequences.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veriframe.llm.common import cut_table, quote, tidy

MAX_LEN = 1024
END_ID = 2
#: Pieces (gaps) of one size that are numbered in one part; more make more parts.
PART_ROWS = 50_000
#: Share of the sequences that unplaced pieces need which a round opens: less gives fuller sequences in more rounds.
OPEN_SHARE = 0.25
#: Entries of a worker's word cache; it is emptied when full.
CACHE_ENTRIES = 400_000

#: The white space of the vocabulary's splitting pattern, other than space and line feed.
_OTHER_SPACE = re.compile("[\\t\\x0b-\\r\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\x00]")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordCache(dict):
    """Ids (little-endian unsigned 32-bit bytes) of a word with the space before it; a leading NUL means that
    no space stands before it. Words of letters only are one unit of the splitting pattern, so the rank table
    of the same vocabulary encodes them directly; everything else goes through the tokenizer."""

    def __init__(self, tokenizer_file: str, ranks_file: str | None):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        # a text that holds one of the vocabulary's added tokens is encoded as a whole
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self.single = None
        if ranks_file:
            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, lines)}
            self.single = tiktoken.Encoding(
                "ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={}
            )._core_bpe.encode_single_piece

    def encode(self, text: str) -> list[int]:
        if self.single and (text[1:] if text[:1] == " " else text).isalpha():
            return self.single(text.encode())
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        if piece[-1:] in (".", ",") and len(piece) > 1 and piece[-2].isalpha():
            found = self[piece[:-1]] + self["\0" + piece[-1]]
        elif piece == "\0":
            found = b""
        else:
            plain = piece if piece == "\n" else piece[1:] if piece[0] == "\0" else " " + piece
            found = array("I", self.encode(plain)).tobytes()
        self[piece] = found
        return found

    def ids(self, text: str) -> bytes:
        """All ids of a text. Cutting at single spaces and line feeds is exact because no unit of the splitting
        pattern crosses them; a text with runs of white space or other white space is encoded as a whole."""
        regular = not (
            "  " in text or "\n " in text or " \n" in text or "\n\n" in text or text[-1:] == " " or text[:1] == " "
        )
        if regular and not _OTHER_SPACE.search(text) and not (self.added and self.added.search(text)):
            return b"".join(map(self.__getitem__, ("\0" + text).replace("\n", " \n \0").split(" ")))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


_caches: dict[tuple, WordCache] = {}


def _cache(*files) -> WordCache:
    if files not in _caches:
        _caches[files] = WordCache(*files)
    return _caches[files]


def cut_points(n: int, max_len: int) -> list[tuple[int, int]]:
    """(start, length) of each piece; only the first may be shorter than ``max_len``."""
    first = n % max_len or min(n, max_len)
    return [(0, first)] + [(s, max_len) for s in range(first, n, max_len)]


def token_pieces(
    docs: DataFrame,
    tokenizer: str = "byte_bpe_50k.json",
    ranks: str | None = "byte_bpe_50k.tiktoken",
    max_len: int = MAX_LEN,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]
    fields += [("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    end = array("I", [end_id]).tobytes()

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(vocabulary_path(tokenizer), vocabulary_path(ranks) if ranks else None)
        for batch in batches:
            out: list[list] = [[] for _ in fields]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = cache.ids(text.as_py() or "") + end
                for k, (start, length) in enumerate(cut_points(len(ids) // 4, max_len)):
                    own = ids[4 * start : 4 * (start + length)]
                    row = (doc_id, k, start, length, zlib.crc32(own)) + (array("I", own).tolist(),) * with_ids
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(out, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(tidy(encode), schema)


def _classes(counts: list[tuple[int, int, int]], max_len: int, open_share: float) -> list[tuple]:
    """(size, kind, height, opens, parts) for each (size, kind, n), kind 0 gaps and 1 pieces: the stack's height before
    the first item, how many pieces open a sequence, and the parts that the items are numbered in. At most
    ``2 * max_len`` rows whatever the corpus, so they are ordered in one place."""
    net = low = larger = 0
    out = []
    for size, kind, n in sorted(counts, key=lambda r: (-r[0], r[1])):
        out.append([size, kind, net - low, max(0, n - (net - low)) if kind else 0, -(-n // PART_ROWS)])
        net += -n if kind else n
        low = min(low, net)
    need = math.ceil(sum(r[0] * r[3] for r in out) * open_share / max_len)
    for r in out:
        left, r[3] = r[3], max(0, min(r[3], need - larger))
        larger += left
    return [tuple(r) for r in out]


def _round(items: DataFrame, counts: list[tuple[int, int, int]], max_len: int, open_share: float) -> DataFrame:
    """The items (kind, uid, size) with what becomes of them: ``state`` placed (with sequence_id and offset), opens,
    stays, or gap (with its new ``size``)."""
    made = _classes(counts, max_len, open_share)
    known = items.sparkSession.createDataFrame(made, "size long, kind int, height long, opens long, parts int")
    least = min(size for size, kind, _ in counts if kind)
    parted = items.join(F.broadcast(known), ["size", "kind"]).filter((F.col("kind") == 1) | (F.col("size") >= least))  # a row a size
    parted = parted.withColumn("part", F.pmod(F.xxhash64("uid", F.lit("rank")), F.col("parts")).cast("int"))
    rank = F.row_number().over(Window.partitionBy("size", "kind", "part").orderBy("uid")) - 1
    if any(r[4] > 1 for r in made):
        numbers = parted.filter("parts > 1").groupBy("size", "kind", "part").agg(F.count("*").alias("m"))
        before = F.sum("m").over(Window.partitionBy("size", "kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
        parted = parted.join(numbers.select("size", "kind", "part", F.coalesce(before, F.lit(0)).alias("before")), ["size", "kind", "part"], "left")
        rank = rank + F.coalesce("before", F.lit(0))
    ranked = parted.withColumn("rank", rank)
    is_gap = F.col("kind") == 0
    served = is_gap | (F.col("rank") < F.col("height"))
    level = F.when(is_gap, F.col("height") + F.col("rank")).when(served, F.col("height") - 1 - F.col("rank"))
    # items without a level are dealt out by a key of their own
    ranked = ranked.withColumn("level", F.coalesce(level, -1 - F.col("uid")))
    sweep = Window.partitionBy("level").orderBy(F.desc("size"), "kind")
    seen = {name: F.lag(name).over(sweep) for name in ("uid", "size")}
    swept = ranked.withColumns({"gap_uid": seen["uid"], "gap_size": seen["size"], "next_kind": F.lead("kind").over(sweep), "next_size": F.lead("size").over(sweep)})
    opens = ~is_gap & ~served & (F.col("rank") - F.col("height") < F.col("opens"))
    state = F.when(is_gap, F.lit("gap")).when(served, F.lit("placed")).when(opens, F.lit("opens")).otherwise(F.lit("stays"))
    size = F.when(is_gap & (F.col("next_kind") == 1), F.col("size") - F.col("next_size")).otherwise(F.col("size"))
    return swept.select(
        "kind", "uid", state.alias("state"), size.alias("size"),
        F.when(served & ~is_gap, F.col("gap_uid")).when(opens, F.col("uid")).alias("sequence_id"),
        F.when(served & ~is_gap, max_len - F.col("gap_size")).when(opens, F.lit(0)).cast("long").alias("offset"),
    )


def pack(pieces: DataFrame, max_len: int = MAX_LEN, open_share: float = OPEN_SHARE) -> DataFrame:
    """Add sequence_id and offset to pieces that have a ``length`` from 1 to ``max_len``. Rounds carry numbers and sizes
    only; the pieces' columns are joined to the places at the end."""
    columns = pieces.columns
    row = F.struct(*[F.col(quote(c)) for c in columns]).alias("row")
    own = cut_table(pieces.select(F.monotonically_increasing_id().alias("uid"), F.col("length").cast("long").alias("size"), row))
    gap_of = lambda df, size: df.select(F.lit(0).alias("kind"), "uid", size.alias("size"))
    piece = lambda df: df.select(F.lit(1).alias("kind"), "uid", "size")
    large = F.col("size") > max_len // 2
    placed = []
    items = gap_of(own.filter(large & (F.col("size") < max_len)), max_len - F.col("size")).unionByName(piece(own.filter(~large)))
    while True:
        counts = [(r["size"], r["kind"], r["n"]) for r in items.groupBy("size", "kind").agg(F.count("*").alias("n")).collect()]  # a row a size
        if not any(kind for _, kind, _ in counts):
            break
        done = cut_table(_round(items, counts, max_len, open_share))
        placed.append(done.filter("state in ('placed', 'opens')").select("uid", "sequence_id", "offset"))
        items = piece(done.filter("state = 'stays'")).unionByName(gap_of(done.filter("state = 'gap' and size > 0"), F.col("size")))
        items = items.unionByName(gap_of(done.filter("state = 'opens'"), max_len - F.col("size")))
    out = own.filter(large).select("row.*", F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if placed:
        out = out.unionByName(own.filter(~large).join(reduce(DataFrame.unionByName, placed), "uid").select("row.*", "sequence_id", "offset"))
    return out


def pack_documents(docs: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Tokenise, cut and pack whole documents."""
    return pack(token_pieces(docs, max_len=max_len), max_len=max_len)
