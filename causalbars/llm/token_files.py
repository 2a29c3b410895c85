"""Token-ID output: flat unsigned integer files with 64-bit document offsets, read by memory mapping.

Documents are range-partitioned and sorted by id, so that file ``k`` precedes file ``k + 1``. One job encodes each
partition into ``part-k.ids`` (little-endian unsigned 16 or 32 bits, as the vocabulary needs) with ``part-k.docs``
(int64 ids) and ``part-k.lens`` (uint32 lengths). A prefix sum over the partitions' token counts (one row per
partition) gives each file its base, and a second job writes ``part-k.offsets``: absolute uint64 offsets, one more
than the file has documents. Files are written under an attempt's own name and then renamed, so a repeated task
leaves the same bytes.
"""

from __future__ import annotations

import functools
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causalbars.llm import common

MANIFEST = "part int, n_docs long, n_null long, n_tokens long"
#: Bytes of encoded pieces that a Python worker remembers, bytes of texts and pieces that are encoded at a time, and
#: documents that are read back at a time.
REMEMBERED, TEXT_BYTES, AT_A_TIME, READ_DOCS = 12 << 20, 1 << 20, 4096, 16_384

#: Descriptions of normalizers and pre-tokenizers that drop white space and never join across it. With
#: them the ids of a text are the ids of its pieces between white space, in a row.
_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PRE_TOKENIZERS = [
    {"type": "Split", "pattern": {"Regex": _PIECES}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]
#: A piece's stem, which ends in a letter, and the points after it, which are a piece of their own to ``_PIECES``.
_CLOSED = r"(?s)^(?P<stem>[^<]*[A-Za-zÀ-ÖØ-öø-ÿ])(?P<points>[!-/:;=-@\[-`{-~]+)$"


#: Pieces that ``_NORMALIZERS`` leave as they are and ``_PRE_TOKENIZERS`` do not split.
_LETTERS = "^[a-zß-öø-ÿ]+$"


def by_pieces(described: dict) -> bool:
    """Whether a tokenizer, as its file describes it, gives a text the ids of its pieces between ASCII white space."""
    plain = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False}
    return (
        described["normalizer"] == {"type": "Sequence", "normalizers": _NORMALIZERS}
        and described["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": _PRE_TOKENIZERS}
        and described["model"]["type"] == "BPE"
        and not any(described["model"].get(k) for k in ("dropout", "unk_token", "fuse_unk"))
        and not any(described.get(k) for k in ("truncation", "padding", "post_processor"))
        and all(plain.items() <= t.items() and t["content"].startswith("<") and not any(c.isspace() for c in t["content"]) for t in described["added_tokens"])
    )


def described_by_pieces(tokenizer) -> bool:
    """As ``by_pieces``; the description takes more memory than the tokenizer itself, so tasks are told the answer."""
    import json

    return by_pieces(json.loads(tokenizer.to_str()))


def _gathered(flat, starts, sizes, at):
    """The runs ``at`` of ``flat`` one after the other, and their sizes."""
    import numpy as np

    each = sizes[at]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    index = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    return flat[np.repeat((starts[at] - (ends - each)).astype(index), each) + np.arange(total, dtype=index)], each


class PieceEncoder:
    """Encodes whole texts by pieces between ASCII white space, remembering the ids of recent pieces.

    That holds for tokenizers of the kind that ``by_pieces`` knows by their description; others encode each text in one
    go. A piece is looked up by its stem, of which ASCII ones are lower-cased, and its closing points, so that fewer
    pieces are new; new stems of letters alone go to the model many at a time. Pieces are split, told apart and looked up by Arrow, a batch at a time. At most ``remembered`` bytes
    are kept from one batch to the next: beyond, only what the last batch used.
    """

    def __init__(self, path: str, dtype: str, remembered: int = REMEMBERED, exact: bool | None = None):
        import os

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.dtype, self.remembered = Tokenizer.from_file(path), dtype, remembered
        self.many = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        self.exact = described_by_pieces(self.tokenizer) if exact is None else exact
        if self.exact:
            from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

            self.words = Tokenizer(self.tokenizer.model)
            self.words.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        self.keys, self.flat, self.sizes = pa.array([], pa.large_string()), np.empty(0, dtype), np.empty(0, np.int32)

    def _ids(self, texts: list[str], n_words: int = 0):
        """(ids of all texts in a row, ids in each). The first ``n_words`` are of ``_LETTERS``."""
        import itertools

        import numpy as np

        flat, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int32)]
        for lo in range(0, n_words, AT_A_TIME):
            own = self.words.encode(" ".join(texts[lo : min(lo + AT_A_TIME, n_words)]), add_special_tokens=False)
            flat.append(np.asarray(own.ids, self.dtype))
            sizes.append(np.bincount(np.asarray(own.word_ids, np.int64)).astype(np.int32))
        for lo in range(n_words, len(texts), AT_A_TIME):
            own = [e.ids for e in self.many(texts[lo : lo + AT_A_TIME], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, own), np.int32, len(own)))
            flat.append(np.fromiter(itertools.chain.from_iterable(own), self.dtype, int(sizes[-1].sum())))
        return np.concatenate(flat), np.concatenate(sizes)

    def _lookup(self, kinds):
        """(ids, starts, sizes, places): the run of each of the distinct ``kinds`` stands at its place."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        place = np.array(pc.index_in(kinds, value_set=self.keys).fill_null(-1))
        missing = np.flatnonzero(place < 0)
        words = np.asarray(pc.match_substring_regex(kinds.take(pa.array(missing)), _LETTERS))
        missing = np.concatenate([missing[words], missing[~words]])
        new = kinds.take(pa.array(missing))
        ids, lens = self._ids(new.to_pylist(), int(words.sum()))
        place[missing] = len(self.keys) + np.arange(len(new))
        flat, sizes, keys = np.concatenate([self.flat, ids]), np.concatenate([self.sizes, lens]), pa.concat_arrays([self.keys, new])
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        if keys.nbytes + flat.nbytes + sizes.nbytes > self.remembered:
            self.keys = pa.concat_arrays([kinds])
            self.flat, self.sizes = _gathered(flat, starts, sizes, place)
        else:
            self.keys, self.flat, self.sizes = keys, flat, sizes
        return flat, starts, sizes, place

    def _pieces(self, pieces):
        """(ids, starts, sizes) of distinct pieces: those of their stems, then those of the points after them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        plain = pc.and_(pc.string_is_ascii(pieces), pc.invert(pc.match_substring(pieces, "<")))
        low = pc.if_else(plain, pc.ascii_lower(pieces), pieces)
        stems, points = pc.extract_regex(low, _CLOSED).flatten()
        both = pa.concat_arrays([pc.coalesce(stems, low), pc.fill_null(points, "")]).dictionary_encode()
        flat, starts, sizes, place = self._lookup(both.dictionary)
        pairs = place[np.asarray(both.indices).reshape(2, -1).T.ravel()]  # each stem and its points
        ids, each = _gathered(flat, starts, sizes, pairs)
        each = each.reshape(-1, 2).sum(axis=1)
        return ids, np.cumsum(each, dtype=np.int64) - each, each

    def encode(self, texts):
        """(ids of all texts in a row, ids in each text) of an Arrow array of strings; null: none. Texts of about
        ``TEXT_BYTES`` are encoded at a time."""
        import numpy as np
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        ends = np.cumsum(np.asarray(pc.binary_length(texts)), dtype=np.int64)
        flat, sizes, lo = [np.empty(0, self.dtype)], [np.empty(0, np.int32)], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, TEXT_BYTES + (ends[lo - 1] if lo else 0), side="right")))
            ids, each = self._encode(texts.slice(lo, hi - lo))
            flat.append(ids)
            sizes.append(each)
            lo = hi
        return np.concatenate(flat), np.concatenate(sizes)

    def _encode(self, texts):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not self.exact:
            return self._ids(texts.to_pylist())
        pieces = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        coded = pieces.flatten().dictionary_encode()
        ids, each = _gathered(*self._pieces(coded.dictionary), np.asarray(coded.indices))
        ends = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        words = np.concatenate([[0], np.cumsum(np.asarray(pieces.value_lengths(), np.int64))])
        return ids, np.diff(ends[words])


@functools.lru_cache(maxsize=1)
def _encoder(path: str, dtype: str, exact: bool) -> PieceEncoder:
    """One for each Python worker, kept between its tasks."""
    encoder = PieceEncoder(path, dtype, exact=exact)
    common.released()  # what reading the tokenizer's file took besides
    return encoder


def _put(root: str, name: str, chunks) -> None:
    import os
    import uuid

    fs, path = common.filesystem(root)
    part = f"{path}/.{name}.{os.getpid()}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as out:
        for chunk in chunks:
            out.write(chunk)
    fs.move(part, f"{path}/{name}")


def _get(root: str, name: str, dtype: str, lo: int = 0, hi: int | None = None):
    """The file's items from ``lo`` to ``hi`` as an array: memory-mapped where it is local, else read."""
    import numpy as np
    from pyarrow import fs as pafs

    fs, path = common.filesystem(root)
    path, wide = f"{path}/{name}", np.dtype(dtype).itemsize
    hi = fs.get_file_info(path).size // wide if hi is None else hi
    if hi <= lo:
        return np.empty(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, dtype=dtype, mode="r")[lo:hi]
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at((hi - lo) * wide, lo * wide), dtype)


def _encode(root: str, tokenizer: str, dtype: str, end_id: int, exact: bool):
    def run(batches):
        import os
        import uuid

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), _encoder(tokenizer, dtype, exact)
        fs, path = common.filesystem(root)
        fs.create_dir(path, recursive=True)
        own = f"{path}/.part-{part:06d}.ids.{os.getpid()}.{uuid.uuid4().hex}"
        docs, lens, n_null = [], [], 0
        with fs.open_output_stream(own) as out:
            for batch in batches:
                n_null += batch.column(0).null_count  # sorted, so they come first
                docs.append(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
                ids, each = encoder.encode(batch.column(1))
                ends = np.cumsum(each)
                out.write(np.insert(ids, ends, np.asarray(end_id, dtype)).tobytes())
                lens.append(each + 1)
        fs.move(own, f"{path}/part-{part:06d}.ids")
        _put(root, f"part-{part:06d}.docs", [x.tobytes() for x in docs])
        sizes = np.concatenate([np.empty(0, "<u4"), *lens]).astype("<u4")
        _put(root, f"part-{part:06d}.lens", [sizes.tobytes()])
        found = [part, len(sizes), n_null, int(sizes.sum(dtype="u8"))]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()).cast(t) for x, t in zip(found, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["part", "n_docs", "n_null", "n_tokens"])

    return common.lean(run)


def _finish(root: str):
    """Writes each file's absolute offsets."""

    def run(batches):
        import numpy as np

        for batch in batches:
            for row in batch.to_pylist():
                lens = _get(root, f"part-{row['part']:06d}.lens", "<u4")
                offsets = np.full(len(lens) + 1, row["base"], "<u8")
                offsets[1:] += np.cumsum(lens, dtype="u8")
                _put(root, f"part-{row['part']:06d}.offsets", [offsets.tobytes()])
            yield batch

    return common.lean(run)


def write_token_files(spark: SparkSession, docs: DataFrame, root: str, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Encodes ``docs(doc_id, text)`` into token files under ``root`` (a folder all executors see); returns the
    manifest: one row per file with its base, its number of documents and tokens, and the ids' type.

    Null text: no words, so the end id alone. Null ids come first (stored as 0, counted in the
    manifest). Rows that share an id are
    ordered by their text, equal rows appear as often as they are given, and other columns are ignored.
    """
    from tokenizers import Tokenizer

    common.small_batches(spark)
    known = Tokenizer.from_file(tokenizer)
    dtype, exact = "<u2" if known.get_vocab_size() <= 65536 and end_id < 65536 else "<u4", described_by_pieces(known)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = keyed.withColumn("h", F.xxhash64("text"))  # splits an id that very many rows share
    ranged = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    parts = common.written(spark, ranged.mapInArrow(_encode(root, tokenizer, dtype, end_id, exact), MANIFEST), "token-parts")
    based = parts.selectExpr("*", "coalesce(sum(n_tokens) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base")
    based = based.filter("n_docs > 0").repartition(max(parts.count(), 1)).mapInArrow(_finish(root), f"{MANIFEST}, base long")
    based.withColumn("dtype", F.lit(dtype)).write.parquet(f"{root}/manifest")
    return spark.read.parquet(f"{root}/manifest")


def _digest(root: str, with_ids: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                name, first, last = f"part-{row['part']:06d}", row["first"], min(row["first"] + READ_DOCS, row["n_docs"])
                docs, offsets = _get(root, f"{name}.docs", "<i8", first, last), _get(root, f"{name}.offsets", "<u8", first, last + 1).astype("i8")
                for lo in range(0, last - first, 1024):
                    own, at = np.asarray(docs[lo : lo + 1024]), offsets[lo : lo + 1025]
                    near = at - row["base"]
                    ids = _get(root, f"{name}.ids", row["dtype"], int(near[0]), int(near[-1]))
                    data = [ids[a:b].astype("<u4") for a, b in zip(near[:-1] - near[0], near[1:] - near[0], strict=True)]
                    columns = [pa.array(own, pa.int64(), mask=np.arange(len(own)) + first + lo < row["n_null"]), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array([zlib.crc32(x.tobytes()) for x in data], pa.int64())]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if with_ids:
                        columns.append(pa.array([x.astype("i8").tolist() for x in data], pa.list_(pa.int64())))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names)

    return common.lean(run)


def read_token_files(spark: SparkSession, root: str, with_ids: bool = False) -> DataFrame:
    """Reads token files back: doc_id, start, n_tokens, ids_crc32 and, if asked for, the ids themselves. Files are read
    in ranges of ``READ_DOCS`` documents, by as many tasks."""
    ranges = spark.read.parquet(f"{root}/manifest").withColumn("first", F.explode(F.expr(f"sequence(0L, n_docs - 1, {READ_DOCS}L)")))
    spread = ranges.repartition(max(ranges.count(), 1))
    return spread.mapInArrow(_digest(root, with_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    root = common.new_dir(spark, "tokens")
    write_token_files(spark, common.table(spark, sf_dir, "documents"), root, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, root)
