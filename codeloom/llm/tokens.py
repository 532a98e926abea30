"""Token-ID output in Simple-8b files (operator 2).

A file is a row of a Parquet table whose column `payload` holds the bytes; a
part of the corpus, contiguous in doc_id order, is a sequence of such files.
Layout of a payload, little endian:

    magic "S8B1" | n_docs u32 | n_ids u32 | n_blocks u32 | n_words u32
    doc_id  i64 * n_docs | ids of the document u32 * n_docs
    first word of each block u32 * n_blocks
    words u64 * n_words
    whether the document has no id, a bit each, padded to bytes; its doc_id is then 0

A block is BLOCK ids (the last one fewer).  A word is a selector in its top
four bits and COUNT[selector] ids of WIDTH[selector] bits below, first id
lowest.  Selectors 0 and 1 are escapes: 0 is one id of 60 bits; 1 is a run,
the id in the low 32 bits and its length in the 28 above.  Blocks start at
known words, so all blocks decode side by side.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, per_process
from .hashing import words

BLOCK = 1024
MAGIC = b"S8B1"
#: Ids in a word and bits of an id for selectors 2 to 15.
COUNT = np.array([1, 0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTH = np.array([60, 32, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bits of small ids.
BITS = np.maximum(1, np.frexp(np.arange(1 << 16, dtype=float))[1]).astype(np.int8)
#: Shortest run that takes the run escape.
RUN = 61
#: Pieces of lower-case Latin letters, digits and marks.
PLAIN = regex.compile(r"[\x21-\x40\x5B-\x7E\xA1-\xAC\xAE-\xBF\xDF-\xFF]+")
#: Fixed value: how a byte-level vocabulary writes the bytes that are no printable Latin-1 character.
BYTES = dict(zip([b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF)], range(256, 324)))
#: Fixed value: how the vocabulary's own splitter cuts words.
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", regex.IGNORECASE)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Simple-8b words of ids below 2**32, and the first word of each block. All blocks advance together, a word at a time."""
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    if int(ids.max()) >> 32:
        raise ValueError("ids take 32 bits at most")
    pad = np.concatenate([ids, np.zeros(64, np.uint64)])
    bits = BITS[pad] if int(ids.max()) < len(BITS) else np.maximum(1, np.frexp(pad.astype(float))[1].astype(np.int8))
    # widest[k][i]: bits of the widest of the ids i .. i + COUNT - 1; doubling gives every window.
    need = {1: bits}
    power = 1
    while power < 64:
        w = need[power]
        need[2 * power] = np.maximum(w, np.concatenate([w[power:], np.zeros(power, np.int8)]))
        power *= 2

    def widest(c):
        top = 1 << (c.bit_length() - 1)
        return need[c] if c == top else np.maximum(need[top], np.concatenate([need[top][c - top :], np.zeros(c - top, np.int8)]))

    choice = np.full(n, 15, np.int8)
    left = np.minimum(BLOCK - (np.arange(n, dtype=np.int32) & (BLOCK - 1)), n - np.arange(n, dtype=np.int32))
    for sel in range(14, 1, -1):
        c = int(COUNT[sel])
        np.copyto(choice, np.int8(sel), where=(widest(c)[:n] <= np.int8(WIDTH[sel])) & (left >= c))
    take = COUNT[choice].astype(np.int64)
    # Runs: how many equal ids follow, within the block.
    change = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1, [n]])
    for a, b in zip(change[:-1][np.diff(change) >= RUN], change[1:][np.diff(change) >= RUN]):
        length = np.minimum(b - np.arange(a, b), left[a:b])
        long = np.flatnonzero(length >= RUN)
        take[a + long], choice[a + long] = length[long], 1
    starts = np.arange(0, n, BLOCK)
    ends = np.minimum(starts + BLOCK, n)
    at, block = starts.copy(), np.arange(len(starts))
    begins = np.zeros(n, bool)
    while len(at):
        begins[at] = True
        at = at + take[at]
        more = at < ends[block]
        at, block = at[more], block[more]
    where = np.flatnonzero(begins)
    sel = choice[where].astype(np.int64)
    words = np.zeros(len(where), np.uint64)
    for s in np.unique(sel):
        m = sel == s
        p = where[m]
        if s == 1:
            words[m] = ids[p] | take[p].astype(np.uint64) << np.uint64(32)
        else:
            x = np.zeros(len(p), np.uint64)
            for i in range(int(COUNT[s])):
                x |= pad[p + i] << np.uint64(i * int(WIDTH[s]))
            words[m] = x
        words[m] |= np.uint64(s) << np.uint64(60)
    return words, np.searchsorted(where, starts).astype(np.uint32)


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of words, selector by selector."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    low = words & np.uint64((1 << 60) - 1)
    count = np.where(sel == 1, (low >> np.uint64(32)).astype(np.int64), COUNT[sel])
    end = np.cumsum(count)
    out = np.zeros(int(end[-1]) if len(end) else 0, np.uint32)
    for s in np.unique(sel):
        m = np.flatnonzero(sel == s)
        begin = end[m] - count[m]
        if s == 1:
            for b, e, v in zip(begin, end[m], low[m]):
                out[b:e] = np.uint32(int(v) & 0xFFFFFFFF)
        else:
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            for i in range(int(COUNT[s])):
                out[begin + i] = ((low[m] >> np.uint64(i * int(WIDTH[s]))) & mask).astype(np.uint32)
    if len(out) != n:
        raise ValueError(f"{len(out)} ids decoded, {n} expected")
    return out


def pack(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nameless: np.ndarray | None = None) -> bytes:
    """A file of documents; `nameless` tells which have no id."""
    packed, blocks = encode(ids)
    head = MAGIC + np.array([len(doc_ids), len(ids), len(blocks), len(packed)], "<u4").tobytes()
    flags = np.packbits(np.zeros(len(doc_ids), bool) if nameless is None else nameless).tobytes()
    return head + np.array(doc_ids, "<i8").tobytes() + np.array(lengths, "<u4").tobytes() + blocks.astype("<u4").tobytes() + packed.astype("<u8").tobytes() + flags


def nameless(payload: bytes) -> np.ndarray:
    """Which documents of a file have no id."""
    d, _, b, w = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
    return np.unpackbits(np.frombuffer(payload, np.uint8, -1, 20 + 12 * d + 4 * b + 8 * w), count=d).astype(bool)


def unpack(payload: bytes, block: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their lengths and all ids; or with `block` only that block's ids, found by its offset."""
    if payload[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    d, n, b, w = (int(x) for x in np.frombuffer(payload, "<u4", 4, 4))
    at = 20
    doc_ids = np.frombuffer(payload, "<i8", d, at)
    lengths = np.frombuffer(payload, "<u4", d, at + 8 * d)
    blocks = np.frombuffer(payload, "<u4", b, at + 12 * d)
    words = np.frombuffer(payload, "<u8", w, at + 12 * d + 4 * b)
    if block is None:
        return doc_ids, lengths, decode(words, n)
    stop = blocks[block + 1] if block + 1 < b else w
    return doc_ids, lengths, decode(words[blocks[block] : stop], min(BLOCK, n - block * BLOCK))


class PieceTokenizer:
    """Ids of whole texts through the tokenizers library, each distinct piece between ASCII white space encoded once.

    Exact where the tokenizer drops white space and no token spans it, as in
    a vocabulary of words with word ends; `drops_space` tells.  Pieces without
    uppercase or special marks share an entry with their other spellings only
    by having the same 64-bit hash.  The memory of a worker is bounded by `most`.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.model = self.tokenizer.model
        # Where lower case is all that a tokenizer sees, spellings share an entry; special tokens are matched as written.
        self.lower = self.ids_of("Aé X") == self.ids_of("aé x")
        # The library's model alone serves pieces of lower-case Latin letters and marks: there the normaliser (NFC, lower
        # case) changes nothing, WORD cuts as the vocabulary's splitter does, and each byte has its own letter.  The
        # samples tell whether the vocabulary is of that kind; a test compares random Unicode with the whole tokenizer.
        self.plain = self.lower and all([x.id for part in WORD.findall(t) for x in self.model.tokenize(self.as_bytes(part))] == self.ids_of(t) for t in ("ab", "don't", "naïveté", "x,y.", "ß1½", "l'été!", "(a)#%*"))
        self.forget()

    @staticmethod
    def as_bytes(part: str) -> str:
        """A word as the model's byte alphabet writes it."""
        return part.encode().decode("latin-1").translate(BYTES)

    def ids_of(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def drops_space(self) -> bool:
        return self.ids_of("ab \n\t cd") == self.ids_of("ab cd") == self.ids_of("ab") + self.ids_of("cd") and self.ids_of(" x ") == self.ids_of("x")

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.bound = np.zeros(1 << 14, np.int64)  # entry k has ids bound[k] .. bound[k + 1] - 1
        self.used = np.zeros(0, np.int64)  # texts' batches that entry k came in

    def shrink(self) -> None:
        """Keep what came more than once, half of the memory at most."""
        used = self.used[: len(self.known)]
        kept = np.flatnonzero(used > 1)
        kept = np.sort(kept[np.argsort(-used[kept], kind="stable")[: self.most // 2]])
        keys = np.fromiter(self.known, np.uint64, len(self.known))[kept]
        begin, count = self.bound[kept], self.bound[kept + 1] - self.bound[kept]
        stop, flat = np.cumsum(count), self.flat
        self.forget()
        total = int(stop[-1]) if len(stop) else 0
        self.flat = np.concatenate([flat[np.repeat(begin - (stop - count), count) + np.arange(total)], np.zeros(1 << 16, np.uint32)])
        self.bound = np.concatenate([[0], stop, np.zeros(1 << 14, np.int64)])
        self.known = dict(zip(keys.tolist(), range(len(kept))))

    def learn(self, keys: list[int], pieces: list[bytes]) -> None:
        """Encode new pieces."""
        got: list = [None] * len(pieces)
        other = []
        texts = [p.decode("utf-8", "replace") for p in pieces]
        for i, t in enumerate(texts):
            if self.plain and PLAIN.fullmatch(t):
                got[i] = [x.id for part in ((t,) if t.isalpha() else WORD.findall(t)) for x in self.model.tokenize(part if t.isascii() else self.as_bytes(part))]
            else:
                other.append(i)
        for i in range(0, len(other), 200):
            # Joined in lines, and told apart by the place of each token.
            line = [texts[k] for k in other[i : i + 200]]
            e = self.tokenizer.encode(" ".join(line), add_special_tokens=False)
            bounds = np.searchsorted([a for a, _ in e.offsets], np.concatenate([[0], np.cumsum([len(x) + 1 for x in line])]))
            for k, a, b in zip(other[i : i + 200], bounds[:-1].tolist(), bounds[1:].tolist()):
                got[k] = e.ids[a:b]
        ids = np.fromiter(itertools.chain.from_iterable(got), np.uint32)
        lengths = np.fromiter(map(len, got), np.int64, len(got))
        k = len(self.known)
        end = self.bound[k] + np.cumsum(lengths)
        if k + len(pieces) + 1 > len(self.bound):
            self.bound = np.concatenate([self.bound, np.zeros(max(len(self.bound), len(pieces) + 1), np.int64)])
        if end[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), int(end[-1])), np.uint32)])
        self.flat[self.bound[k] : end[-1]] = ids
        self.bound[k + 1 : k + 1 + len(pieces)] = end
        self.known.update(zip(keys, range(k, k + len(pieces))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Lengths of the texts, and all their ids in one array."""
        raw = [t.encode() for t in texts]
        special = {i for i, r in enumerate(raw) if b"<|" in r}  # may hold a special token: encoded as they are
        hashes, start, end, sizes, joined = words([b"" if i in special else r for i, r in enumerate(raw)], lower=self.lower)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        keys = distinct.tolist()
        if len(self.known) > self.most:
            self.shrink()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            at = first[new]
            pieces = [joined[a:b] for a, b in zip(start[at].tolist(), end[at].tolist())]
            self.learn([keys[i] for i in new], [p.lower() if self.lower else p for p in pieces])
        entry = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        if len(self.used) < len(self.known):
            self.used = np.concatenate([self.used, np.zeros(2 * len(self.known) - len(self.used), np.int64)])
        self.used[entry] += 1
        k = entry[inverse]
        begin, count = self.bound[k], self.bound[k + 1] - self.bound[k]
        stop = np.cumsum(count)
        total = int(stop[-1]) if len(stop) else 0
        ids = self.flat[np.repeat(begin - (stop - count), count) + np.arange(total)]
        lengths = np.diff(np.concatenate([[0], stop])[np.concatenate([[0], np.cumsum(sizes)])])
        for i in sorted(special):
            own = self.ids_of(texts[i])
            at = int(lengths[:i].sum())
            ids = np.concatenate([ids[:at], np.array(own, np.uint32), ids[at:]])
            lengths[i] = len(own)
        return lengths, ids


def write_ids(docs: DataFrame, scratch: Scratch, path: str, end_id: int, file_ids: int = 1 << 20) -> DataFrame:
    """Encode every text and write the files; returns their table (part, seq, n_docs, n_ids, at, payload).

    Documents are range-partitioned by doc_id and sorted (equal ids by text),
    so parts, and files in a part, follow each other in that order; `at` is
    the number of ids of the part before the file.  A file ends with the
    document that brings it to `file_ids` ids.  Null text: empty, the end id
    alone.  Null ids come first, and stay null.  Repeated rows stay.  Empty
    table: no files.  Whole texts are encoded; extra columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        tk = per_process("tokenizer", path, lambda: PieceTokenizer(path))
        whole = not tk.drops_space()
        part, seq, held, n, at = TaskContext.get().partitionId(), 0, [], 0, 0

        def file():
            lengths = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            doc_ids = np.concatenate([h[0] for h in held])
            payload = pack(doc_ids, lengths, ids, np.concatenate([h[3] for h in held]))
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(doc_ids)], "n_ids": [len(ids)], "at": [at], "payload": [payload]})

        for batch in batches:
            for i in range(0, len(batch), 256):
                doc_ids = batch["doc_id"].to_numpy()[i : i + 256]
                texts = list(batch["text"].iloc[i : i + 256])
                if whole:
                    got = [np.array(tk.ids_of(t), np.uint32) for t in texts]
                    lengths, ids = np.array([len(g) for g in got]), np.concatenate(got)
                else:
                    lengths, ids = tk.encode(texts)
                ids = np.insert(ids, np.cumsum(lengths), end_id)
                held.append((doc_ids, lengths + 1, ids, batch["nameless"].to_numpy()[i : i + 256]))
                n += len(ids)
                if n >= file_ids:
                    yield file()
                    seq, held, n, at = seq + 1, [], 0, at + n
        if held:
            yield file()

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    d = d.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), "text", F.col("doc_id").isNull().alias("nameless"))
    return scratch.save(d.mapInPandas(run, "part int, seq int, n_docs int, n_ids long, at long, payload binary"), "files")


def read_ids(files: DataFrame) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    # A row for each part, that is each task that wrote.
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for payload, at in zip(batch["payload"], batch["at"]):
                doc_ids, lengths, ids = unpack(payload)
                end = np.cumsum(lengths.astype(np.int64))
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(end.tolist(), lengths.tolist())]
                named = pd.Series(doc_ids).astype("Int64").mask(nameless(payload))
                yield pd.DataFrame({"doc_id": named, "start": at + end - lengths, "n_tokens": lengths.astype(np.int64), "ids_crc32": crc})

    joined = files.join(F.broadcast(parts), "part").select("payload", (F.col("at") + F.col("before")).alias("at"))
    return joined.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
