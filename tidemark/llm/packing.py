"""Token ids in binary files: fixed-width bit packing with blocks that can be read alone.

Texts move once, into ranges of ids. A task encodes its documents in order with the `tokenizers` library and
packs them into files of about `FILE_TOKENS` ids; a document is never cut between files. Every id takes
the least bits that hold the whole vocabulary. 64 ids fill exactly `bits` words of 64 bits, so numpy
packs and unpacks all groups of 64 at once, and a block of `BLOCK` ids begins on a word.

A file, little-endian: header (`HEADER`); the document ids as an Arrow stream; the number of ids of each document
(u64); the offsets of the blocks in the payload (u64, one more than blocks); the payload; the
CRC-32 of all before; a line feed, as Spark's text writer ends its rows. Spark writes them, so a task that is
run again leaves no second copy. `_files` beside them lists the files with the ids and positions they hold.

A text is encoded word by word: its normalizer, its splitting and its merges never look across ASCII white space
(nor between a letter and a mark behind it, nor, in a very long word, before an ASCII digit). New words of letters are
encoded together, as one text. Words are remembered in two halves of up to `MEMO`; when the younger one is full it takes the place of the older one.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.common import list_array, narrow, pieces

BLOCK = 4096
FILE_TOKENS = 1 << 22
MEMO = 200_000
MEMO_BYTES = 64  # longer words are not remembered
LONG_WORD = 4096
PIECE_BYTES = 1 << 20

# ASCII letters and digits, the second bytes of the letters of Latin-1 in UTF-8, and the marks of ASCII
# but for the one that special tokens have behind letters.
_ALNUM = np.zeros(256, bool)
_ALNUM[[*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True
_LATIN_1 = np.zeros(256, bool)
_LATIN_1[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{}~"]] = True
# Mark, version, bits of an id, ids of a block, task and number of the file in it, documents, ids,
# bytes of the document ids.
HEADER = struct.Struct("<8sHHIIIQQQ")
MAGIC = b"TIDEPACK"
FILES = "_files"


def head_of(raw: bytes) -> tuple:
    return HEADER.unpack_from(raw)


def width(vocabulary: int) -> int:
    """The least bits that hold every id below `vocabulary`."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> np.ndarray:
    """64-bit words with `bits` bits for each id; the last group of 64 is filled up with zeros."""
    groups = -(-len(ids) // 64)
    rows = np.zeros((groups, 64), np.uint64)
    rows.reshape(-1)[: len(ids)] = ids
    out = np.zeros((groups, bits), np.uint64)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        out[:, word] |= rows[:, k] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= rows[:, k] >> np.uint64(64 - shift)
    return out.reshape(-1)


def unpack(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    """The first `n` ids of packed words."""
    groups = words.reshape(-1, bits)
    out = np.empty((len(groups), 64), np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for k in range(64):
        word, shift = divmod(k * bits, 64)
        value = groups[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            value = value | (groups[:, word + 1] << np.uint64(64 - shift))
        out[:, k] = value & mask
    return out.reshape(-1)[:n]


def file_image(
    doc_ids: pa.Array, lengths: np.ndarray, ids: np.ndarray, bits: int, part: int, seq: int
) -> bytes:
    """The bytes of a file, without the line feed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("doc_id", doc_ids.type)])) as stream:
        stream.write_batch(pa.RecordBatch.from_arrays([doc_ids], names=["doc_id"]))
    names = sink.getvalue().to_pybytes()
    payload = pack(ids, bits)
    starts = np.arange(-(-len(ids) // BLOCK) + 1, dtype=np.uint64) * np.uint64(BLOCK // 8 * bits)
    starts[-1] = payload.nbytes
    body = b"".join(
        [
            HEADER.pack(MAGIC, 1, bits, BLOCK, part, seq, len(lengths), len(ids), len(names)),
            names,
            lengths.astype("<u8").tobytes(),
            starts.astype("<u8").tobytes(),
            payload.astype("<u8", copy=False).tobytes(),
        ]
    )
    return body + struct.pack("<I", zlib.crc32(body))


class PackedFile:
    """A file that was read: its documents, and the ids of any range."""

    def __init__(self, content: bytes, check: bool = True):
        view = memoryview(content)
        mark, version, self.bits, self.block, self.part, self.seq, docs, self.tokens, named = head_of(view)
        if mark != MAGIC or version != 1:
            raise ValueError("not a file of packed ids")
        end = len(view) - 5  # the checksum and the line feed
        if check and struct.unpack_from("<I", view, end)[0] != zlib.crc32(view[:end]):
            raise ValueError("a file of packed ids is damaged")
        at = HEADER.size
        names = pa.ipc.open_stream(view[at : at + named]).read_all().column(0)
        self.doc_ids = names.chunk(0) if names.num_chunks == 1 else names.combine_chunks()
        at += named
        self.lengths = np.frombuffer(view, "<u8", docs, at).astype(np.int64)
        at += 8 * docs
        self.offsets = np.frombuffer(view, "<u8", -(-self.tokens // self.block) + 1, at).astype(np.int64)
        self.payload = view[at + 8 * len(self.offsets) : end]

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """Ids lo to hi (exclusive) of the file. Only the blocks that hold them are unpacked."""
        hi = self.tokens if hi is None else min(hi, self.tokens)
        if lo >= hi:
            return np.zeros(0, np.uint32)
        first, last = lo // self.block, -(-hi // self.block)
        a, b = self.offsets[first], self.offsets[last]
        words = np.frombuffer(self.payload[a:b], "<u8")
        return unpack(words, self.bits, hi - first * self.block)[lo - first * self.block :]


def parted(body: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts with a space between a letter or digit and a mark behind it.

    A tokenizer that takes letters, digits and other characters apart, and drops white space, does the same with both.
    Letters are those of ASCII and Latin-1.
    """
    if len(body) < 2:
        return body, begins
    letter = _ALNUM[body[:-1]]
    letter[1:] |= (body[:-2] == 0xC3) & _LATIN_1[body[1:-1]]
    edge = _MARK[body[1:]] & letter
    edge[begins[(begins > 0) & (begins < len(body))] - 1] = False
    at = np.flatnonzero(edge) + 1
    return np.insert(body, at, 0x20), begins + np.searchsorted(at, begins, "left")


class Words:
    """Encodes texts with a tokenizer of the library, word by word."""

    _made: dict[int, Words] = {}

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_str(spec)
        self.young: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.special = [t.content.lower().encode() for t in self.library.get_added_tokens_decoder().values()]
        # Ids that end a piece, where the vocabulary marks them.
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        same = lambda a, b: self.library.encode(a, add_special_tokens=False).ids == self.library.encode(b, add_special_tokens=False).ids
        self.lowers = same("ABC Xyz", "abc xyz")
        self.parts = same("abc. 1, x", "abc . 1 , x") and not any(
            _MARK[b] and _ALNUM[a] for t in self.special for a, b in zip(t, t[1:])
        )
        # The same model for lower case of ASCII, which needs no normalizer and no splitting but by spaces.
        self.bare = Tokenizer.from_str(spec)
        self.bare.normalizer = None
        self.bare.pre_tokenizer = WhitespaceSplit()

    @classmethod
    def of(cls, spec: str) -> Words:
        key = hash(spec)
        if key not in cls._made:
            cls._made[key] = cls(spec)
        return cls._made[key]

    def _split(self, text: bytes) -> list[bytes]:
        found = text.split()
        if len(text) > LONG_WORD and max(map(len, found), default=0) > LONG_WORD:
            found = [p for w in found for p in (re.split(rb"(?=[0-9])", w) if len(w) > LONG_WORD else [w]) if p]
        return found

    def _texts(self, body: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """The texts in a form that has fewer different words, and the same ids."""
        if self.parts:
            body, begins = parted(body, begins)
        raw = body.tobytes()
        if self.lowers:
            # The tokenizer lowers everything but its special tokens.
            lowered = raw.lower()
            if not any(t in lowered for t in self.special):
                raw = lowered
        at = begins.tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _ids(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of each word as bytes of u32, by word."""
        found: dict[bytes, bytes] = {}
        plain, letters, rest = [], [], []
        for word in words:
            if self.lowers and word.isalpha() and word.islower():
                plain.append(word)
            else:
                (letters if word.decode("utf-8", "replace").isalpha() else rest).append(word)
        # A word of letters is one piece, which ends with a marked id: all of them are encoded as one text.
        for own, library in ((plain, self.bare), (letters, self.library)):
            if not own:
                continue
            text = b" ".join(own).decode("utf-8", "replace")
            ids = np.array(library.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            cut = np.flatnonzero(self.ends[ids]) + 1
            if len(cut) == len(own) and cut[-1] == len(ids):
                raw, at = ids.tobytes(), (4 * cut).tolist()
                found.update((w, raw[a:b]) for w, a, b in zip(own, [0, *at], at))
            else:
                rest += own
        made = self.library.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        found.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, made))
        return found

    def encode(self, body: np.ndarray, begins: np.ndarray) -> list[bytes]:
        """The ids of each of some texts, which begin at `begins`, as bytes of u32, little-endian."""
        if len(self.young) > MEMO:
            self.older, self.young = self.young, {}
        split = [self._split(t) for t in self._texts(body, begins)]
        # The words of this run, in a table of their own: small enough to stay in the cache.
        here: dict[bytes, bytes | None] = dict.fromkeys(chain.from_iterable(split))
        known, older, new = self.young, self.older, []
        for word in here:
            ids = known.get(word)
            if ids is None:
                ids = older.get(word)
                if ids is None:
                    new.append(word)
                    continue
                known[word] = ids
            here[word] = ids
        for lo in range(0, len(new), 2048):
            made = self._ids(new[lo : lo + 2048])
            here.update(made)
            known.update(made)
        for word in new:
            if len(word) > MEMO_BYTES:
                del known[word]
        return [b"".join(map(here.__getitem__, words)) for words in split]


def write(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> None:
    """Write the ids of all texts to `path`, in ascending order of the document ids.

    `tokenizer` is the path of a file of the `tokenizers` library, read in the driver only. It must never merge
    across white space. `end_id` is appended to each document, also to NULL and empty texts, which have no
    other ids. Rows without an id come first; rows that share an id go by a hash of their text. Rows
    that are equal each get a place. An empty table gives no files.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    bits = width(max(Words(spec).library.get_vocab_size(), 1 + (end_id or 0)))
    held = docs.sparkSession.sparkContext.broadcast(spec)
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, words = TaskContext.get().partitionId(), Words.of(held.value)
        seq, ids, texts, n = 0, [], [], 0

        def image() -> pa.RecordBatch:
            lengths = np.array([len(t) // 4 for t in texts], np.int64)
            names = pa.concat_arrays(ids).cast(id_type)
            made = file_image(names, lengths, np.frombuffer(b"".join(texts), "<u4"), bits, part, seq)
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["value"])

        for batch in batches:
            for lo, hi, body, begins in pieces(batch.column(1), min(PIECE_BYTES, file_tokens)):
                made = [t + end for t in words.encode(body, begins)]
                ids.append(batch.column(0).slice(lo, hi - lo))
                texts += made
                n += sum(map(len, made)) // 4
                if n >= file_tokens:
                    yield image()
                    seq, ids, texts, n = seq + 1, [], [], 0
        if texts:
            yield image()

    rows = narrow(docs, id_col, text_col).toDF("id", "text")
    order = [F.col("id"), F.xxhash64("text"), F.col("row")]
    ranged = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions("id", F.xxhash64("text"), "text")
    )
    images = ranged.select("id", "text").mapInArrow(run, "value binary")
    # The text writer stores the bytes as they are, a file for each row, and a line feed.
    images.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\n"
    ).text(path)
    _list_files(docs.sparkSession, path, kind)


def _contents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0")


def _list_files(spark: SparkSession, path: str, kind: T.DataType) -> None:
    """Write `_files`: per file its name, task, number, documents, ids, and the position of its first id.

    Positions are sums within a task, which Spark makes, and over tasks: one number per task is
    summed in the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [head_of(h.as_py()) for h in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    *[pa.array([h[k] for h in heads], pa.int64()) for k in (4, 5, 6, 7)],
                ],
                names=["file", "part", "seq", "docs", "tokens"],
            )

    heads = _contents(spark, path).select("path", F.substring("content", 1, HEADER.size).alias("head"))
    files = heads.mapInArrow(run, "file string, part long, seq long, docs long, tokens long")
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files.withColumn("within", F.coalesce(F.sum("tokens").over(before), F.lit(0))).write.parquet(f"{path}/{FILES}")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, part, seq, docs, tokens, start): `start` is the position of the file's first id in the whole."""
    files = spark.read.parquet(f"{path}/{FILES}")
    sums = files.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    base = np.cumsum([0, *[r["n"] for r in sums]]).tolist()
    bases = spark.createDataFrame([(r["part"], b) for r, b in zip(sums, base)], "part long, base long")
    return files.join(F.broadcast(bases), "part").select(
        "file", "part", "seq", "docs", "tokens", (F.col("base") + F.col("within")).alias("start")
    )


def read(spark: SparkSession, path: str, id_type: str = "long", digests: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids.

    `start` counts the ids of all documents before. With `digests`, there is `ids_crc32` instead of the ids: the
    unsigned CRC-32 of the ids as u32, little-endian. A damaged file raises an error.
    """
    last = "ids_crc32 long" if digests else "ids array<int>"
    schema = T.StructType([T.StructField("doc_id", T._parse_datatype_string(id_type)), *T.StructType.fromDDL(f"part long, seq long, within long, n_tokens long, {last}")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                found = PackedFile(content.as_py())
                at = np.zeros(len(found.lengths) + 1, np.int64)
                np.cumsum(found.lengths, out=at[1:])
                n = len(found.lengths)
                step = 0
                while step < n:
                    # Some documents at a time: about 2^20 ids, or one document.
                    stop = max(step + 1, int(np.searchsorted(at, at[step] + (1 << 20), "right")) - 1)
                    ids = found.ids(at[step], at[stop])
                    own = at[step : stop + 1] - at[step]
                    if digests:
                        raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                        value = pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(own, own[1:])], pa.int64())
                    else:
                        value = list_array(ids.view(np.int32), np.diff(own), pa.int32())
                    k = stop - step
                    columns = [
                        found.doc_ids.slice(step, k),
                        pa.array(np.full(k, found.part, np.int64)),
                        pa.array(np.full(k, found.seq, np.int64)),
                        pa.array(at[step:stop]),
                        pa.array(found.lengths[step:stop]),
                        value,
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=schema.names)
                    step = stop

    rows = _contents(spark, path).select("content").mapInArrow(run, schema)
    # One row per file of ids; Spark broadcasts it only while it is small.
    starts = list_files(spark, path).select("part", "seq", F.col("start").alias("file_start"))
    return rows.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", schema.names[-1]
    )


def take(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """Random access: (position, id) of the positions lo to hi (exclusive) of all ids.

    Only the files that hold them are opened, and of these only the blocks.
    """
    files = list_files(spark, path).where((F.col("start") < hi) & (F.col("start") + F.col("tokens") > lo))
    wanted = {r["file"]: r["start"] for r in files.select("file", "start").collect()}
    if not wanted:
        return spark.createDataFrame([], "position long, id int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                start = wanted[name.as_py()]
                first = max(lo - start, 0)
                ids = PackedFile(content.as_py(), check=False).ids(first, hi - start)
                position = np.arange(start + first, start + first + len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(position), pa.array(ids.view(np.int32))], names=["position", "id"])

    return _contents(spark, list(wanted)).select("path", "content").mapInArrow(run, "position long, id int")
