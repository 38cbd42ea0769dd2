"""Token ids as length-delimited binary records with an offset index.

A file is a run of frames, each of one document, in the public TFRecord framing: length
(uint64), masked CRC-32C of the length, payload, masked CRC-32C of the payload, all little
endian. The payload is the document's ids as uint16 where the vocabulary fits, else uint32.
The index is a Parquet table (doc_id, file, position, n_tokens, start); it lets a reader fetch
records in any order, as shuffled training reads do, and carries ``start``, the number of
ids before the document in the whole data set.

Documents are dealt out by ranges of doc_id and sorted within each, so file k holds the k-th
range; each task streams its own file and keeps one batch in memory. A file is written under
a name of its attempt and renamed when whole, so a task that is lost and run again replaces
it with the same bytes. Files go through pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import gc
import json
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
CHUNK = 64  # words of a checksum lane
#: White space other than the space and the line end, and characters that Unicode versions disagree on.
OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]")
FILE_BYTES = 256 << 20  # of text a file, where the session asks for no more files


# -- checksums -----------------------------------------------------------------------------

def _tables() -> np.ndarray:
    """Slicing tables of CRC-32C (reflected polynomial 0x82F63B78): row k advances a byte k more bytes."""
    t = np.zeros((4, 256), dtype=np.uint32)
    r = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        r = np.where(r & 1, (r >> 1) ^ np.uint32(0x82F63B78), r >> 1)
    t[0] = r
    for k in range(1, 4):
        t[k] = (t[k - 1] >> 8) ^ t[0][t[k - 1] & 0xFF]
    return t


TABLES = _tables()


def _step(state: np.ndarray) -> np.ndarray:
    """The state after four zero bytes."""
    return TABLES[3][state & 0xFF] ^ TABLES[2][(state >> 8) & 0xFF] ^ TABLES[1][(state >> 16) & 0xFF] ^ TABLES[0][state >> 24]


@lru_cache(maxsize=1)
def _leap() -> np.ndarray:
    """Tables like TABLES that advance a state by CHUNK words."""
    out = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for _ in range(CHUNK):
        out = _step(out)
    return out


def crc32c(words: np.ndarray, lengths: np.ndarray, tails: np.ndarray | None = None) -> np.ndarray:
    """CRC-32C of many records at once. ``words``: their 32-bit words, one record after the other;
    ``lengths``: words of each; ``tails``: two more bytes at the end, for records where it is >= 0.

    A record is padded in front with zero words, which leave a zero state zero; the initial
    state is then a change to its first word. Lanes of CHUNK words run side by side and are joined
    by the tables of _leap."""
    lengths = np.asarray(lengths, dtype=np.int64)
    n = len(lengths)
    chunks = -(-lengths // CHUNK)
    first = np.cumsum(chunks) - chunks
    flat = np.zeros(int(chunks.sum()) * CHUNK, dtype=np.uint32)
    ends = (first + chunks) * CHUNK
    starts = ends - lengths
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    flat[at] = words
    some = lengths > 0
    flat[starts[some]] ^= np.uint32(0xFFFFFFFF)
    lanes = np.ascontiguousarray(flat.reshape(-1, CHUNK).T)
    state = np.zeros(lanes.shape[1], dtype=np.uint32)
    for row in lanes:
        state = _step(state ^ row)
    leap = _leap()
    out = np.where(some, np.uint32(0), np.uint32(0xFFFFFFFF)).astype(np.uint32)
    order = np.argsort(-chunks, kind="stable")
    longest = int(chunks.max(initial=0))
    alive = np.searchsorted(-chunks[order], -np.arange(longest), side="left")
    for k in range(longest):
        who = order[: alive[k]]
        s = out[who]
        out[who] = leap[0][s & 0xFF] ^ leap[1][(s >> 8) & 0xFF] ^ leap[2][(s >> 16) & 0xFF] ^ leap[3][s >> 24] ^ state[first[who] + k]
    if tails is not None:
        more = np.flatnonzero(tails >= 0)
        s = out[more]
        for shift in (0, 8):
            s = (s >> 8) ^ TABLES[0][(s ^ (tails[more] >> shift).astype(np.uint32)) & 0xFF]
        out[more] = s
    assert len(out) == n
    return ~out


def masked(crc: np.ndarray) -> np.ndarray:
    return (((crc >> 15) | (crc << 17)) + np.uint32(0xA282EAD8)).astype(np.uint32)


def payload_crc(payloads: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of payloads of even length."""
    even = np.array([len(p) // 4 for p in payloads])
    tails = np.array([int.from_bytes(p[-2:], "little") if len(p) % 4 else -1 for p in payloads], dtype=np.int64)
    words = np.frombuffer(b"".join(p[: len(p) // 4 * 4] for p in payloads), dtype="<u4")
    return masked(crc32c(words, even, tails))


def frames(payloads: list[bytes]) -> list[bytes]:
    sizes = np.array([len(p) for p in payloads], dtype="<u8")
    head = masked(crc32c(sizes.view("<u4"), np.full(len(payloads), 2))).astype("<u4")
    body = payload_crc(payloads).astype("<u4")
    return [s.tobytes() + h.tobytes() + p + b.tobytes() for s, h, p, b in zip(sizes, head, payloads, body, strict=True)]


# -- tokens --------------------------------------------------------------------------------

class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once.

    A byte-level pre-tokeniser without normaliser always breaks before a space that follows a
    visible character, so a text is the run of its pieces cut there, and its ids are theirs in turn.
    Unknown pieces of a batch are encoded as one string and cut apart by the tokens' lengths. A text that holds
    an added token's string (the library gives that token's id), or white space other than single
    spaces and line ends within, is encoded as it is."""

    def __init__(self, path: str, end_id: int, known: int = 800_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_word = not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if max(size, end_id + 1) <= 65536 else "<u4")
        self.length = np.zeros(size, dtype=np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.length[i] = len(token)  # one character stands for each byte
        self.end = np.array([end_id], dtype=self.dtype).tobytes()
        self.most, self.ids, self.again, self.after_line = known, {}, set(), {}
        self.marks = {m: self.whole(m) for m in ".,;:!?"}
        self.plain = re.compile("[A-Za-z0-9À-ÖØ-öø-ɏ]").match

    @staticmethod
    def _even(t: str) -> bool:
        """Whether all white space is single spaces and line ends between visible characters, and
        nothing stands there that Unicode versions disagree on."""
        return bool(t) and t[0] not in " \n" and t[-1] not in " \n" and not ("  " in t or "\n\n" in t or " \n" in t or "\n " in t) and not OTHER_SPACE.search(t)

    def whole(self, text: str) -> bytes:
        return np.array(self._ids(text), dtype=self.dtype).tobytes()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids  # encodes without offsets

    def _learn_words(self, words: list[str]) -> None:
        """Words of visible characters are encoded; a word and a mark, or several words with single line
        ends between them, are put together, as the pre-tokeniser always breaks there too."""
        ids, after, marks = self.ids, self.after_line, self.marks
        lined = [p for p in words if "\n" in p]
        if lined:
            words = [p for p in words if "\n" not in p]
        marked = [p for p in words if p[-1] in marks and self.plain(p[-2:-1])]
        stems = [p[:-1] for p in marked]
        simple = set(stems).difference(ids)
        simple.update(set(words).difference(marked) if marked else words)
        joined, starts, later = [], [], []
        for p in lined:
            first, *rest = p.split("\n")
            joined.append((p, [self._marked(first, starts.append), *(self._marked(r, later.append) for r in rest)]))
        simple.update(set(starts).difference(ids))
        self._learn(list(simple), " ", ids)
        self._learn(list(set(later).difference(after)), "\n", after)
        ids.update(zip(marked, [ids[w] + marks[p[-1]] for w, p in zip(stems, marked, strict=True)], strict=True))
        for p, parts in joined:
            ids[p] = b"".join(known[w] + marks.get(m, b"") for known, (w, m) in zip([ids] + [after] * len(parts), parts, strict=False))

    def _marked(self, word: str, put: Callable) -> tuple[str, str | None]:
        cut = len(word) > 1 and word[-1] in self.marks and self.plain(word[-2])
        word, mark = (word[:-1], word[-1]) if cut else (word, None)
        put(word)
        return word, mark

    def _learn(self, words: list[str], before: str, known: dict[str, bytes]) -> None:
        """Encodes ``before`` and the word, for each word."""
        for i in range(0, len(words), 20_000):
            some = words[i : i + 20_000]
            text = before + before.join(some)
            ids = np.array(self._ids(text))
            ends = np.cumsum(self.length[ids])
            # A word ends where the next one's space or line end stands, which no word holds itself.
            data = np.frombuffer(text.encode(), dtype=np.uint8)
            stops = np.append(np.flatnonzero(data == ord(before))[1:], len(data))
            cuts = ((np.searchsorted(ends, stops, side="left") + 1) * self.dtype.itemsize).tolist()
            raw = ids.astype(self.dtype).tobytes()
            known.update(zip(some, map(raw.__getitem__, map(slice, [0, *cuts], cuts)), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text and the end id, as bytes."""
        was = gc.isenabled()
        gc.disable()  # nothing here refers in circles, and what is known would be gone through again and again
        try:
            return self._encode(texts)
        finally:
            if was:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") if self.by_word and self._even(t) and not any(a in t for a in self.added) else None for t in texts]
        firsts = [parts.pop(0) if parts else None for parts in split]  # the first word has no space before it
        words: set[str] = set()
        for parts in split:
            if parts:
                words.update(parts)
        unknown = words.difference(self.ids)
        self.again |= words - unknown
        if len(self.ids) + len(unknown) > self.most:
            self.forget()
            unknown = words.difference(self.ids)
        self._learn_words(list(unknown))
        begins = iter(self.tokenizer.encode_batch_fast([f for f in firsts if f], add_special_tokens=False))
        get, out = self.ids.__getitem__, []
        for t, first, parts in zip(texts, firsts, split, strict=True):
            if parts is None:
                out.append(self.whole(t) + self.end)
            else:
                out.append((np.array(next(begins).ids, dtype=self.dtype).tobytes() if first else b"") + b"".join(map(get, parts)) + self.end)
        return out

    def forget(self) -> None:
        """Keeps the words that came in another batch after the one they were learnt from; none where these fill half of the memory."""
        self.ids = {p: self.ids[p] for p in self.again} if len(self.again) <= self.most // 2 else {}
        self.again, self.after_line = set(), {}

    def rest(self) -> None:
        """Gives all words up; they are learnt again where texts ask for them."""
        self.ids, self.again, self.after_line = {}, set(), {}


_encoders: dict[tuple[str, int], WordEncoder] = {}


def word_encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder, with the words it knows, for each Python worker."""
    if (path, end_id) not in _encoders:
        _encoders.clear()
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


# -- files ---------------------------------------------------------------------------------

def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _name(part: int) -> str:
    return f"part-{part:06d}.tfrecord"


INDEX = "doc_id bigint, part int, position bigint, n_bytes bigint, n_tokens bigint, before bigint"


def _writer(folder: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = _file_system(folder)
        fs.create_dir(root, recursive=True)
        attempt = f"{root}/_attempt-{uuid.uuid4().hex}"
        encoder, position, before = word_encoder(vocabulary, end_id), 0, 0
        with fs.open_output_stream(attempt) as out:
            for batch in batches:
                payloads = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                framed = frames(payloads)
                for f in framed:
                    out.write(f)
                size = np.array([len(f) for f in framed], dtype=np.int64)
                count = np.array([len(p) for p in payloads], dtype=np.int64) // encoder.dtype.itemsize
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id"), "part": pa.array(np.full(len(size), part, dtype=np.int32)),
                    "position": pa.array(position + np.cumsum(size) - size), "n_bytes": pa.array(size),
                    "n_tokens": pa.array(count), "before": pa.array(before + np.cumsum(count) - count)})
                position += int(size.sum())
                before += int(count.sum())
        if position:
            fs.move(attempt, f"{root}/{_name(part)}")
        else:
            fs.delete_file(attempt)

    return common.trimmed(write)


def _reader(folder: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _file_system(folder)
        for encoder in _encoders.values():
            encoder.rest()  # the files are written; what a worker still holds would stand beside all that follows
        for batch in batches:
            part, pos, size, count = (batch.column(c).to_numpy() for c in ("part", "position", "n_bytes", "n_tokens"))
            out: list[bytes] = [b""] * len(part)
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                rows = rows[np.argsort(pos[rows])]
                with fs.open_input_file(f"{root}/{_name(int(p))}") as f:
                    # Neighbouring records come in one read.
                    cuts = np.flatnonzero(pos[rows][1:] != (pos + size)[rows][:-1]) + 1
                    for run in np.split(rows, cuts):
                        start = int(pos[run[0]])
                        data = f.read_at(int(pos[run[-1]] + size[run[-1]]) - start, start)
                        for i in run.tolist():
                            out[i] = data[int(pos[i]) - start : int(pos[i] + size[i]) - start]
            payloads = [b[12:-4] for b in out]
            heads = np.array([int.from_bytes(b[:8], "little") for b in out], dtype="<u8")
            if any(h != len(p) for h, p in zip(heads.tolist(), payloads, strict=True)):
                raise OSError("a record's length differs from the index")
            crc = np.array([(int.from_bytes(b[8:12], "little"), int.from_bytes(b[-4:], "little")) for b in out], dtype=np.uint32).reshape(-1, 2)
            if (masked(crc32c(heads.view("<u4"), np.full(len(out), 2))) != crc[:, 0]).any() or (payload_crc(payloads) != crc[:, 1]).any():
                raise OSError("a record's checksum is wrong")
            ids = [np.frombuffer(p, dtype=f"<u{len(p) // n}").astype("<u4").tobytes() for p, n in zip(payloads, count.tolist(), strict=True)]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "ids": pa.array(ids, pa.binary())})

    return common.trimmed(read)


def write_records(docs: DataFrame, folder: str, *, vocabulary: str | None = None, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the files and the index into ``folder`` and returns the index.

    Null texts count as empty and give the end id alone. Null ids come first, equal ids stand in
    the order of their texts' hash, repeated rows give a record each. Only id and text are read, so other
    columns may have any name. An empty table gives an index without rows and no file.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), common.text_of(text_col).alias("text"))
    if files is None:  # by size: a file holds about file_bytes of text, and no fewer files than the session has partitions
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // file_bytes))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(files, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    rows.mapInArrow(_writer(folder, vocabulary, end_id), INDEX).write.parquet(f"{folder}/index-parts")
    parts = spark.read.schema(INDEX).parquet(f"{folder}/index-parts")
    # One row per file: the ids of all files before it.
    base = parts.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn(
        "base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    index = parts.join(F.broadcast(base.drop("n")), "part").select(
        "doc_id", "part", F.format_string("part-%06d.tfrecord", "part").alias("file"), "position", "n_bytes", "n_tokens", (F.col("base") + F.col("before")).alias("start"))
    index.write.parquet(f"{folder}/index")
    return open_index(spark, folder)


def open_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """doc_id, start and ids (little-endian uint32) of the index rows given, read from the files;
    lengths and checksums are verified. Any subset and any order of the index will do."""
    common.small_batches(index.sparkSession)
    return index.select("doc_id", "part", "position", "n_bytes", "n_tokens", "start").mapInArrow(_reader(folder), "doc_id bigint, start bigint, ids binary")


def op9(spark, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "token-records")
    index = write_records(common.table(spark, sf_dir, "documents"), folder)
    return read_records(index, folder).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
