"""Token ids in files of independent zstandard frames with a seek table.

A file (``part-00000.zst``) is a row of zstandard frames, a skippable frame with the first id of each, and the trailing
skippable frame that zstandard's seekable format defines: for each frame its compressed size, its uncompressed size and a checksum (the low half of XXH64 of its content), then the
number of frames, a descriptor and a magic number. Any zstandard reader can read the whole file; a reader of one document
takes the last bytes, the table and the one frame. A frame holds up to ``FRAME_DOCS`` documents: their number n, n ids
(int64), n token counts (int64), then all tokens as uint32, little-endian.

Documents are range-partitioned by id, so a task writes one file of consecutive ids; files are written under another name
and renamed, so a task that is run again replaces its file with an equal one. Words repeat far more than texts: each worker
keeps the ids of words that it has seen, up to ``CACHE_WORDS``, and asks the tokenizer for the rest.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.fs
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from vocalith.plans.scratch import new_path

FRAME_DOCS, FRAME_TOKENS = 64, 1 << 18
#: Bytes of text of a file, about.
FILE_BYTES = 48 << 20
#: Entries of each of a worker's two caches, about 200 bytes each. A full cache takes no more; frequent words come early.
CACHE_WORDS = 400_000
INDEX, SKIPPABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
#: White space by Unicode, which the tokenizer drops; Python's ``split`` also takes 0x1C to 0x1F, which are rare.
SPACE = re.compile(r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = re.compile(r"[\x1c-\x1f]").search
_encoders: dict = {}


class WordEncoder:
    """Ids of texts as little-endian uint32: ``whole`` equals encoding each whole text with the tokenizer as its file has it.

    ``encode`` takes the strings of added tokens for ordinary text; ``whole`` gives a text that can hold one, in whatever
    case, to the unchanged tokenizer, as such a token also cuts the words around it.

    It asks for a tokenizer that lower-cases, splits at white space and then by ``PATTERN``, and encodes each piece alone;
    ``of`` refuses others. Words are looked up first, then their pieces, and the tokenizer's model encodes new pieces. Words
    with characters beyond Latin-1 go through the whole tokenizer.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.given, self.tokenizer = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        added = sorted(t.content for t in self.given.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added)) or "(?!)", re.IGNORECASE).search
        kept = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (kept["normalizer"] or {}).get("normalizers", [])], [x["type"] for x in (kept["pre_tokenizer"] or {}).get("pretokenizers", [])]
        if steps != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) or kept["pre_tokenizer"]["pretokenizers"][0]["pattern"] != {"Regex": self.PATTERN}:
            raise ValueError(f"not a tokenizer of lower-case words with word ends: {steps}")
        self.model, self.pieces_of = self.tokenizer.model, regex.compile(self.PATTERN).findall
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        self.shown = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> WordEncoder:
        """One for each worker process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def _piece(self, x: str) -> bytes:
        got = self.pieces.get(x)
        if got is None:
            got = np.array([t.id for t in self.model.tokenize("".join([self.shown[b] for b in x.encode()]))], "<u4").tobytes()
            if len(self.pieces) < CACHE_WORDS:
                self.pieces[x] = got
        return got

    def _word(self, w: str) -> bytes:
        if w.isascii() or max(w) <= "\xff":
            got = b"".join([self._piece(x) for x in self.pieces_of(w.lower())])
        else:
            got = np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) < CACHE_WORDS and len(w) < 64:
            self.words[w] = got
        return got

    def encode(self, text: str | None) -> bytes:
        words = (SPACE.split(text) if ODD(text) else text.split()) if text else []
        found = list(map(self.words.get, words))
        if None in found:
            found = [self._word(w) if got is None else got for w, got in zip(words, found, strict=True)]
        return b"".join(found)

    def whole(self, text: str | None) -> bytes:
        if text and self.added(text):
            return np.array(self.given.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encode(text)


def frame(ids: list[int], tokens: list[bytes]) -> bytes:
    counts = np.array([len(t) // 4 for t in tokens], "<i8")
    return struct.pack("<q", len(ids)) + np.array(ids, "<i8").tobytes() + counts.tobytes() + b"".join(tokens)


def unframe(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    n = struct.unpack_from("<q", raw)[0]
    ids, counts = np.frombuffer(raw, "<i8", n, 8), np.frombuffer(raw, "<i8", n, 8 + 8 * n)
    tokens, ends = np.frombuffer(raw, "<u4", offset=8 + 16 * n), np.cumsum(counts)
    for k in range(n):
        yield int(ids[k]), tokens[ends[k] - counts[k] : ends[k]]


def seek_table(entries: list[tuple[int, int, int]]) -> bytes:
    body = b"".join(struct.pack("<III", *e) for e in entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


class Writer:
    """One file; frames are compressed as they fill."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out, self.packer = self.fs.open_output_stream(self.own), zstandard.ZstdCompressor(level=1)
        self.entries, self.firsts, self.ids, self.tokens, self.held = [], [], [], [], 0

    def add(self, doc_id: int, tokens: bytes) -> None:
        self.ids.append(doc_id)
        self.tokens.append(tokens)
        self.held += len(tokens) // 4
        if len(self.ids) >= FRAME_DOCS or self.held >= FRAME_TOKENS:
            self._flush()

    def _flush(self) -> None:
        if self.ids:
            raw = frame(self.ids, self.tokens)
            packed = self.packer.compress(raw)
            self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.firsts.append(self.ids[0])
            self.out.write(packed)
            self.ids, self.tokens, self.held = [], [], 0

    def close(self) -> None:
        self._flush()
        index = np.array(self.firsts, "<i8").tobytes()
        self.out.write(struct.pack("<II", INDEX, len(index)) + index)
        self.out.write(seek_table([*self.entries, (8 + len(index), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)]))
        self.out.close()
        self.fs.move(self.own, self.path)


class Reader:
    """One file: the table first, frames on request."""

    def __init__(self, uri: str):
        self.fs, self.path = pyarrow.fs.FileSystem.from_uri(uri)
        self.file = self.fs.open_input_file(self.path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"no seek table in {uri}")
        rows = np.frombuffer(self.file.read_at(12 * n, size - 9 - 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.sizes, self.raw, self.checks = rows.T
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.firsts = np.frombuffer(self.file.read_at(int(self.sizes[-1]) - 8, int(self.starts[-1]) + 8), "<i8")

    def __len__(self) -> int:
        return len(self.firsts)

    def frames_of(self, ids: np.ndarray) -> list[int]:
        """Frames that can hold one of the ids; equal ids can lie in neighbouring frames."""
        lo, hi = np.searchsorted(self.firsts, ids, "left") - 1, np.searchsorted(self.firsts, ids, "right") - 1
        return sorted({k for a, b in zip(lo.tolist(), hi.tolist(), strict=True) for k in range(max(a, 0), b + 1)})

    def frame(self, k: int) -> Iterator[tuple[int, np.ndarray]]:
        packed = self.file.read_at(int(self.sizes[k]), int(self.starts[k]))
        raw = zstandard.ZstdDecompressor().decompress(packed, max_output_size=int(self.raw[k]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.checks[k]:
            raise ValueError(f"frame {k} of {self.path} does not match its checksum")
        return unframe(raw)


def write(documents: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``documents`` below the URI ``folder`` in ascending order of ids; one row per file: number, uri, documents, tokens.

    Null texts are empty ones, empty texts are their end id alone, null ids are an error in a file of ids and come first as
    the lowest number. Repeated ids are each written, in the order of their texts' hashes. Other columns are not read. An
    empty table gives no file.
    """
    low = -(1 << 63)
    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(low)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // FILE_BYTES))
    dealt = rows.repartitionByRange(files, "id").sortWithinPartitions("id", F.xxhash64("text"))

    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, writer, encoder, end = TaskContext.get().partitionId(), None, WordEncoder.of(tokenizer), struct.pack("<I", end_id)
        uri, docs, total, first = f"{folder}/part-{number:05d}.zst", 0, 0, None
        for batch in batches:
            writer = writer or Writer(uri)
            for doc_id, text in zip(batch["id"], batch["text"], strict=True):
                ids, first = encoder.whole(text), int(doc_id) if first is None else first
                writer.add(int(doc_id), ids + end)
                docs, total = docs + 1, total + len(ids) // 4 + 1
        if writer:
            writer.close()
            yield pd.DataFrame({"file": [number], "uri": [uri], "n_docs": [docs], "n_tokens": [total], "first_id": [first]})

    return dealt.mapInPandas(packed, "file int, uri string, n_docs long, n_tokens long, first_id long")


def manifest(files: DataFrame) -> DataFrame:
    """The rows of ``write``, run once and held by the driver (a row a file), with each file's first document and token."""
    rows = sorted(files.collect(), key=lambda r: r.file)
    out, doc, token = [], 0, 0
    for r in rows:
        out.append((r.file, r.uri, r.n_docs, r.n_tokens, r.first_id, doc, token))
        doc, token = doc + r.n_docs, token + r.n_tokens
    return files.sparkSession.createDataFrame(out, "file int, uri string, n_docs long, n_tokens long, first_id long, first_doc long, first_token long").repartition(max(1, len(out)), "file")


def read(listed: DataFrame) -> DataFrame:
    """Every document of the files of a manifest: doc_id, start, n_tokens, ids_crc32 and tokens' checksum, in file order."""

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                reader, at = Reader(r.uri), r.first_token
                for k in range(len(reader)):
                    rows = []
                    for doc_id, ids in reader.frame(k):
                        rows.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                        at += len(ids)
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])

    found = listed.mapInPandas(opened, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.withColumn("doc_id", F.expr(f"nullif(doc_id, {-(1 << 63) + 1} - 1)"))


def fetch(listed: DataFrame, wanted: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Tokens of the documents in ``wanted`` (doc_id, tokens array): each file's reader decompresses only frames it needs.

    ``wanted`` is a table of ids, joined by file through the files' ranges; ids that no file holds give no row.
    """
    spark = listed.sparkSession
    heads = sorted((r.first_id, r.file, r.uri) for r in listed.select("file", "uri", "first_id").collect())  # a row a file
    ends = [*(first - 1 for first, _, _ in heads[1:]), (1 << 63) - 1]
    bounds = spark.createDataFrame([(n, uri, a, b) for (a, n, uri), b in zip(heads, ends, strict=True)], "file int, uri string, lo long, hi long")
    asked = wanted.select(F.col(id_col).alias("id")).distinct().join(F.broadcast(bounds), F.expr("id >= lo and id <= hi"))

    def picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for uri, ids in batch.groupby("uri")["id"]:
                reader, need = Reader(uri), set(ids.tolist())
                for k in reader.frames_of(ids.to_numpy()):
                    out = [(i, t.astype(np.int64).tolist()) for i, t in reader.frame(k) if i in need]
                    yield pd.DataFrame(out, columns=["doc_id", "tokens"])

    near = asked.repartitionByRange(max(1, len(heads)), "id").sortWithinPartitions("id")
    return near.mapInPandas(picked, "doc_id long, tokens array<long>")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in files of the word-end vocabulary with end id 1, read back."""
    import public_tokenizers

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    listed = manifest(write(documents, new_path(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 1))
    return read(listed)
