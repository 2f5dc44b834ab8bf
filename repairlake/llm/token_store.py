"""Token ids in a content-addressed store.

Format (three Parquet tables in one folder; digests are SHA-256):

* chunks (digest, ids): each distinct chunk once; ids are little-endian unsigned integers of 2 bytes, or
  of 4 where the vocabulary needs them (meta: width);
* recipes (part, place, doc_id, n_tokens, start, digests, leaf): documents in ascending doc_id order. The
  stream of a part is its documents' by place; start counts the ids before a document in its part. leaf is
  the digest of all of these but the part;
* manifests (part, first_token, n_docs, n_tokens, root, width): the Merkle root of the leaves of a part and
  the number of ids before it;
* root (parts, n_docs, n_tokens, root): one row, the Merkle root of the parts' roots.

A document's ids are cut where a rolling hash of the last 4 ids has its low 8 bits zero, at least 64 and at
most 1024 ids from the last cut, so that equal passages give equal chunks wherever they stand. Reading
first checks that the parts are those of the root, each as its manifest says, then every chunk against its
digest. What is missing or changed, in whichever table, raises.

Where the tokenizer is one that splits on white space (WORDWISE tells by its own normaliser and splitter),
texts are encoded word by word through a bounded cache of words, and words of small letters by the tokenizer's
merges alone; no normalisation reaches across what a text is cut at, so the ids are those of encoding it at
once (compared on random texts in the tests). Any other tokenizer gets whole texts.

Defined cases: a null text counts as empty (its only id is the end id). Null ids come last. Rows of equal
doc_id follow each other, ordered by their chunk digests. An empty table gives an empty store. Columns other
than doc_id and text are not read. Broken stores raise.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, staged, unstage
from .wordhash import groups_of, mix, ngrams

END_ID = 1
ROLL, CUT_MASK, LEAST, MOST = 4, 0xFF, 64, 1024
PART_DOCS = 20_000
CACHE_WORDS = 1_200_000

_encoders: dict[str, Encoder] = {}


#: The normaliser and splitter for which words can be encoded one by one.
WORDWISE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
#: The letter by which byte-level merges write each byte (a blank stays): printable Latin-1 itself, the others those from U+0100 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_LETTERS = np.arange(256, dtype="<u2")
BYTE_LETTERS[sorted({*range(256)} - {*_PRINTABLE})] = np.arange(256, 256 + 256 - len(_PRINTABLE))
BYTE_LETTERS[32] = 32


class Encoder:
    """A tokenizer with what a Python worker keeps of it."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.width = 2 if self.whole.get_vocab_size() <= 65536 else 4
        self.kind = "H" if self.width == 2 else "I"
        self.cache: dict[bytes, bytes] = {}
        told = json.loads(self.whole.to_str())
        suffix = told["model"].get("end_of_word_suffix")
        self.wordwise = bool(suffix) and (told["normalizer"], told["pre_tokenizer"]) == WORDWISE and told["post_processor"] is None
        if self.wordwise:
            self.merges = Tokenizer.from_str(json.dumps(told | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
            vocabulary = self.whole.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True

    def texts(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind, e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """The ids of words. Those of small Latin letters only are one piece each, which ends with the one id of
        theirs that ends a word, so that they can be merged many at a time."""
        texts = [w.decode() for w in words]
        plain = [i for i, t in enumerate(texts) if t.isalpha() and (t.isascii() or max(t) < "\u0250") and t == t.lower()]
        out: dict[bytes, bytes] = {}
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            lines = [b" ".join([words[i] for i in some[j : j + 256]]) for j in range(0, len(some), 256)]
            lines = [BYTE_LETTERS[np.frombuffer(x, np.uint8)].tobytes().decode("utf-16-le") for x in lines]
            ids = array(self.kind, [x for e in self.merges.encode_batch_fast(lines, add_special_tokens=False) for x in e.ids])
            stops = ((np.flatnonzero(self.ends[np.frombuffer(ids, np.dtype(self.kind))]) + 1) * ids.itemsize).tolist()
            if len(stops) != len(some):
                raise ValueError("the tokenizer does not end each word with one id")
            raw, begin = ids.tobytes(), 0
            for i, stop in zip(some, stops, strict=True):
                out[words[i]] = raw[begin:stop]
                begin = stop
        if len(plain) < len(words):
            held = set(plain)
            rest = [i for i in range(len(words)) if i not in held]
            out.update(zip([words[i] for i in rest], self.texts([texts[i] for i in rest]), strict=True))
        return out


def _encoder(path: str) -> Encoder:
    """One for each tokenizer in a Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _fold(text: str) -> bytes:
    """Letters in lower case, as the tokenizer makes them, where nothing can depend on their case: neither a
    special token's string nor a mark (U+0300 to U+037F) that composes with a letter. Letters beyond ASCII
    only where the whole text is Latin-1."""
    raw = text.encode()
    if b"<|" in raw or b"\xcc" in raw or b"\xcd" in raw:
        return raw
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return raw.lower()
    return raw.lower() if text.isascii() else text.lower().encode()


def _stem(word: bytes) -> bytes | None:
    """What precedes closing punctuation that the tokenizer splits off: that after a Latin letter. (Not after
    a dotted capital I, whose lower case ends in a mark.)"""
    stem = word.rstrip(b".,!?;:%&*#$")
    if not stem or len(stem) == len(word) or b"<|" in word:
        return None
    if stem[-1] < 128:
        return stem if 97 <= stem[-1] <= 122 else None
    last = stem.decode()[-1]
    return stem if last.isalpha() and last < "\u0250" and last != "\u0130" else None


def _distinct_words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """The distinct words of texts (UTF-8; a text may add an empty one), which of them each word is, and where each
    text's words begin, with the end."""
    lists = pc.ascii_split_whitespace(pa.array(texts, pa.string()))
    coded = lists.values.dictionary_encode()
    n = len(coded.dictionary)
    joined = pc.binary_join(pa.ListArray.from_arrays([0, n], coded.dictionary.cast(pa.binary())), b"\n")[0].as_py()
    return joined.split(b"\n")[:n], coded.indices.to_numpy(), lists.offsets.to_numpy()


def encode_all(texts: list[str | None], path: str, end_id: int = END_ID) -> list[bytes]:
    """The ids of each text with the end id, as bytes of the store's width."""
    its = _encoder(path)
    end = array(its.kind, [end_id]).tobytes()
    texts = [t or "" for t in texts]
    out = []
    for begin, stop in groups_of(texts, 4 << 20):
        if not its.wordwise:
            out += [ids + end for ids in its.texts(texts[begin:stop])]
            continue
        cache = its.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
        cache[b""] = b""
        words, which, bounds = _distinct_words([_fold(t) for t in texts[begin:stop]])
        each = list(map(cache.get, words))
        missing = [i for i, ids in enumerate(each) if ids is None]
        closed: list[tuple[bytes, bytes, bytes]] = []
        whole: set[bytes] = set()
        for w in map(words.__getitem__, missing):
            stem = _stem(w)
            if stem is None:
                whole.add(w)
                continue
            closed.append((w, stem, w[len(stem) :]))
            whole.update(x for x in closed[-1][1:] if x not in cache)
        cache.update(its.words(list(whole)))
        for w, stem, tail in closed:
            cache[w] = cache[stem] + cache[tail]
        for i in missing:
            each[i] = cache[words[i]]
        size = np.fromiter(map(len, each), np.int64, len(each)) // len(end)
        n = size[which]
        stops = np.concatenate(([0], np.cumsum(n)))
        place = np.repeat((np.cumsum(size) - size)[which] - stops[:-1], n) + np.arange(stops[-1])
        ids = np.frombuffer(b"".join(each), np.dtype(its.kind))[place].tobytes()
        at = (stops[bounds] * len(end)).tolist()
        out += [ids[i:j] + end for i, j in zip(at, at[1:])]
    return out


def marks(ids: np.ndarray) -> np.ndarray:
    """Places after which the rolling hash asks for a cut."""
    g = ngrams(mix(ids.astype(np.uint64) + np.uint64(1)), ROLL)
    return np.flatnonzero((g & np.uint64(CUT_MASK)) == 0) + ROLL


def cuts(n: int, asked: list[int]) -> list[int]:
    """The ends of the chunks of n ids with those marks, ascending; the first ROLL - 1 places cannot be cuts."""
    out, last = [], 0
    for m in asked:
        while m - last > MOST:
            last += MOST
            out.append(last)
        if m - last >= LEAST and m < n:
            out.append(m)
            last = m
    while n - last > MOST:
        last += MOST
        out.append(last)
    out.append(n)
    return out


def leaf(doc_id: int | None, place: int, start: int, n_tokens: int, digests: list[bytes]) -> bytes:
    return hashlib.sha256(struct.pack("<?qqqq", doc_id is not None, doc_id or 0, place, start, n_tokens) + b"".join(digests)).digest()


def merkle(leaves: list[bytes]) -> bytes:
    """The root of a Merkle tree; an odd node moves up as it is. Of no leaves: the digest of nothing."""
    if not leaves:
        return hashlib.sha256(b"").digest()
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\x01" + leaves[i] + leaves[i + 1]).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + ([leaves[-1]] if len(leaves) % 2 else [])
    return leaves[0]


@lru_cache(4096)
def _crc_columns(n_bytes: int) -> tuple[int, ...]:
    """What so many zero bytes make of each bit of a CRC-32 register."""
    def square(m):
        return [times(m, c) for c in m]

    def times(m, v):
        s, i = 0, 0
        while v:
            if v & 1:
                s ^= m[i]
            v >>= 1
            i += 1
        return s

    m = [0xEDB88320] + [1 << i for i in range(31)]  # one bit
    for _ in range(3):
        m = square(m)  # one byte
    out = [1 << i for i in range(32)]
    while n_bytes:
        if n_bytes & 1:
            out = [times(m, c) for c in out]
        m = square(m)
        n_bytes >>= 1
    return tuple(out)


@lru_cache(4096)
def _crc_nibbles(n_bytes: int) -> list[list[int]]:
    """_crc_columns by four bits at a time."""
    columns, out = _crc_columns(n_bytes), []
    for at in range(0, 32, 4):
        row = [0]
        for c in columns[at : at + 4]:
            row += [c ^ r for r in row]
        out.append(row)
    return out


def crc_joined(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two pieces from their own, the second of n_bytes."""
    a, b, c, d, e, f, g, h = _crc_nibbles(n_bytes)
    x = first
    return second ^ a[x & 15] ^ b[x >> 4 & 15] ^ c[x >> 8 & 15] ^ d[x >> 12 & 15] ^ e[x >> 16 & 15] ^ f[x >> 20 & 15] ^ g[x >> 24 & 15] ^ h[x >> 28]


def write_store(docs: DataFrame, where: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encodes docs (doc_id, text) and writes the store to a folder that executors share."""

    def rows(b: dict) -> dict:
        width = _encoder(tokenizer).width
        got: dict[str, list] = {c: [] for c in ("doc_id", "n_tokens", "digests", "blobs", "width")}
        seen: set[bytes] = set()
        raws = encode_all(b["text"], tokenizer, end_id)
        asked = marks(np.frombuffer(b"".join(raws), f"<u{width}"))  # of all texts at once; none is used that spans two
        at = 0
        for doc_id, raw in zip(b["doc_id"], raws, strict=True):
            n = len(raw) // width
            own = asked[np.searchsorted(asked, at + LEAST) : np.searchsorted(asked, at + n)] - at
            at += n
            digests, blobs, begin = [], [], 0
            for end in cuts(n, own.tolist()):
                blob = raw[begin * width : end * width]
                digest = hashlib.sha256(blob).digest()
                digests.append(digest)
                blobs.append(None if digest in seen else blob)
                seen.add(digest)
                begin = end
            for c, v in zip(got, (doc_id, n, digests, blobs, width), strict=True):
                got[c].append(v)
        return got

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = staged(arrow_map(docs, rows, "doc_id long, n_tokens long, digests array<binary>, blobs array<binary>, width int", at_once=2000), "encoded", "zstd")
    each = made.select(F.explode(F.arrays_zip("digests", "blobs")).alias("c")).select(F.col("c.digests").alias("digest"), F.col("c.blobs").alias("ids"))
    each.where("ids is not null").groupBy("digest").agg(F.first("ids").alias("ids")).write.option("compression", "zstd").parquet(f"{where}/chunks")

    def place(b: dict, count: list) -> dict:
        from pyspark import TaskContext

        got: dict[str, list] = {c: [] for c in ("part", "place", "doc_id", "n_tokens", "start", "digests", "leaf", "width")}
        part = TaskContext.get().partitionId()
        for doc_id, n, digests, width in zip(b["doc_id"], b["n_tokens"], b["digests"], b["width"], strict=True):
            for c, v in zip(got, (part, count[0], doc_id, n, count[1], digests, leaf(doc_id, count[0], count[1], n, digests), width), strict=True):
                got[c].append(v)
            count[0] += 1
            count[1] += n
        return got

    order = [F.col("doc_id").asc_nulls_last(), F.col("digests")]
    parts = max(1, -(-made.count() // PART_DOCS))
    ordered = made.select("doc_id", "n_tokens", "digests", "width").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shape = "part int, place long, doc_id long, n_tokens long, start long, digests array<binary>, leaf binary, width int"
    arrow_map(ordered, place, shape, lambda: [0, 0]).write.parquet(f"{where}/recipes")
    unstage(made)
    spark = docs.sparkSession
    totals = _roots(spark.read.parquet(f"{where}/recipes"), check=False)
    ahead = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens")
    totals.withColumn("first_token", ahead).write.parquet(f"{where}/manifests")
    told = _manifests(spark, where)
    summary = (len(told), sum(r.n_docs for r in told), sum(r.n_tokens for r in told), bytearray(merkle([bytes(r.root) for r in told])))
    spark.createDataFrame([summary], "parts long, n_docs long, n_tokens long, root binary").coalesce(1).write.parquet(f"{where}/root")


def _manifests(spark: SparkSession, where: str) -> list:
    """The manifests by part: a row for each PART_DOCS documents."""
    return spark.read.parquet(f"{where}/manifests").orderBy("part").collect()


def _roots(recipes: DataFrame, check: bool = True) -> DataFrame:
    """(part, n_docs, n_tokens, root, width, whole) from the recipes, a few tens of thousands a task. whole, if
    check: the leaves are those of what they stand for, and places and starts leave no gap."""
    own = recipes.select("part", "place", "start", "n_tokens", "leaf", "width", *(["doc_id", "digests"] if check else []))

    def solve(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("place")
        told, places, starts, sizes = pdf["leaf"].map(bytes).tolist(), pdf["place"].tolist(), pdf["start"].tolist(), pdf["n_tokens"].tolist()
        whole = True
        if check:
            ids = [None if d is None or d != d else int(d) for d in pdf["doc_id"].astype("Int64").astype(object).where(pdf["doc_id"].notna(), None)]
            made = [leaf(d, p, s, n, list(x)) for d, p, s, n, x in zip(ids, places, starts, sizes, pdf["digests"], strict=True)]
            whole = made == told and places == list(range(len(pdf))) and starts == [0, *np.cumsum(sizes)[:-1].tolist()]
        return pd.DataFrame({"part": [key[0]], "n_docs": [len(pdf)], "n_tokens": [int(sum(sizes))], "root": [merkle(told)], "width": [int(pdf["width"].iloc[0])], "whole": [whole]})

    return own.groupBy("part").applyInPandas(solve, "part int, n_docs long, n_tokens long, root binary, width int, whole boolean")


def store_root(spark: SparkSession, where: str) -> str:
    """The Merkle root of the whole store in hex."""
    return bytes(spark.read.parquet(f"{where}/root").first().root).hex()


def verify(spark: SparkSession, where: str) -> None:
    """Raises ValueError unless the recipes are, part by part, those of the manifests, and these those of the root."""
    recipes, manifests, told = spark.read.parquet(f"{where}/recipes"), _manifests(spark, where), spark.read.parquet(f"{where}/root").collect()
    if len(told) != 1:
        raise ValueError("the store has no root")
    if (len(manifests), sum(r.n_docs for r in manifests), sum(r.n_tokens for r in manifests), merkle([bytes(r.root) for r in manifests])) != (*told[0][:3], bytes(told[0].root)):
        raise ValueError("the manifests do not make up the store's root")
    first = 0
    for r in manifests:
        if r.first_token != first:
            raise ValueError(f"part {r.part} does not begin where the one before it ends")
        first += r.n_tokens
    own = spark.read.parquet(f"{where}/manifests").select("part", *[F.col(c).alias(f"m_{c}") for c in ("n_docs", "n_tokens", "root", "width")])
    same = F.col("whole")
    for c in ("n_docs", "n_tokens", "root", "width"):
        same = same & F.col(c).eqNullSafe(F.col(f"m_{c}"))
    wrong = _roots(recipes).join(own, "part", "full_outer").where(~F.coalesce(same, F.lit(False))).select("part").limit(5).collect()
    if wrong:
        raise ValueError(f"recipes do not match the manifests of parts {sorted(r.part for r in wrong)}")


def read_store(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document from the store's files. The store is verified first,
    each chunk as it is read."""
    verify(spark, where)
    chunks, recipes, manifests = (spark.read.parquet(f"{where}/{t}") for t in ("chunks", "recipes", "manifests"))
    first = manifests.select("width").first()
    if first is None:
        return recipes.select("doc_id", "start", "n_tokens", F.lit(0).cast("long").alias("ids_crc32"))
    width = first.width

    def check(b: dict) -> dict:
        got: dict[str, list] = {"digest": b["digest"], "n": [], "crc": []}
        wide = memoryview(np.frombuffer(b"".join(b["ids"]), f"<u{width}").astype("<u4").tobytes())
        at = 0
        for digest, blob in zip(b["digest"], b["ids"], strict=True):
            if hashlib.sha256(blob).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} does not hold what its digest says")
            n = len(blob) // width
            got["n"].append(n)
            got["crc"].append(zlib.crc32(wide[at : at + 4 * n]))
            at += 4 * n
        return got

    def join(b: dict) -> dict:
        got: dict[str, list] = {c: [] for c in ("part", "place", "n", "ids_crc32")}
        for part, place, sizes, crcs in zip(b["part"], b["place"], b["sizes"], b["crcs"], strict=True):
            crc = 0
            for n, c in zip(sizes, crcs, strict=True):
                crc = crc_joined(crc, c, 4 * n)
            for c, v in zip(got, (part, place, sum(sizes), crc), strict=True):
                got[c].append(v)
        return got

    known = arrow_map(chunks, check, "digest binary, n int, crc long")
    each = recipes.select("part", "place", F.posexplode("digests").alias("pos", "digest")).join(known, "digest", "left")
    each = each.withColumn("crc", F.coalesce("crc", F.raise_error(F.lit("a chunk of a recipe is missing"))))
    of = each.groupBy("part", "place").agg(F.array_sort(F.collect_list(F.struct("pos", "n", "crc"))).alias("of"))
    of = of.select("part", "place", F.col("of.n").alias("sizes"), F.col("of.crc").alias("crcs"))
    crcs = arrow_map(of, join, "part int, place long, n long, ids_crc32 long")
    own = recipes.select("part", "place", "doc_id", "start", "n_tokens").join(crcs, ["part", "place"], "left").join(manifests.select("part", "first_token"), "part")
    whole = F.when(F.col("n") == F.col("n_tokens"), F.col("n_tokens")).otherwise(F.raise_error(F.lit("a document has lost ids")).cast("long"))
    return own.select("doc_id", (F.col("first_token") + F.col("start")).alias("start"), whole.alias("n_tokens"), "ids_crc32")


def read_ids(spark: SparkSession, where: str) -> DataFrame:
    """(doc_id, ids array<long>) of each document, rebuilt from its chunks."""
    verify(spark, where)
    chunks, recipes, manifests = (spark.read.parquet(f"{where}/{t}") for t in ("chunks", "recipes", "manifests"))
    first = manifests.select("width").first()
    width = first.width if first else 4
    right = F.when(F.sha2("ids", 256) == F.lower(F.hex("digest")), F.col("ids")).otherwise(F.raise_error(F.lit("a chunk does not hold what its digest says")).cast("binary"))
    each = recipes.select("part", "place", "doc_id", F.posexplode("digests").alias("pos", "digest")).join(chunks.select("digest", right.alias("ids")), "digest", "left")
    each = each.withColumn("ids", F.coalesce("ids", F.raise_error(F.lit("a chunk of a recipe is missing")).cast("binary")))
    of = each.groupBy("part", "place").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("of"))

    def rows(b: dict) -> dict:
        return {"doc_id": b["doc_id"], "ids": [np.frombuffer(b"".join(p["ids"] for p in of), f"<u{width}").tolist() for of in b["of"]]}

    return arrow_map(of.select("doc_id", "of"), rows, "doc_id long, ids array<long>")
