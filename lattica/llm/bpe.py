"""Byte-pair encoding and decoding of whole texts with a public vocabulary.

A text is split into words by the rules of the vocabulary file.  A short word is
held as a contiguous array of parts (boundaries and ids) with the rank of each
adjacent pair; the smallest rank is looked for, leftmost first, its boundary is
deleted and the ranks of both neighbours are refreshed, until no pair has a
rank.  Words of over ``SHORT`` bytes take the same merges in the same order from
a heap, so that their time doesn't grow with the square of their length.  Parts
of a word are kept for the next time it comes, up to ``CACHE_BYTES`` of words.

The vocabulary (a few MB, the size of its file) is read on the driver and sent
with the task.  Texts never leave their row: no shuffle.

Defined results: null and empty texts, and texts of nothing but white space, have
no ids and decode to the empty text.  Strings of special tokens in a text are
those tokens.  Ids that the vocabulary doesn't have, and null ids, decode to
nothing; a null array decodes to the empty text.  Repeated rows are encoded each
on its own; an empty table gives an empty result.  Other columns are kept; one
of the name of a new column is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from lattica.llm import _text as T
from lattica.llm._io import table

SHORT = 128  # bytes of a word that is merged by scans
CACHE_BYTES = 64 << 20
NONE = 1 << 60

#: How byte-level vocabularies split texts when their file gives no pattern (fixed value).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters on which all releases of Unicode of the last years agree; texts with others are split by the tokenizers
#: library, whose tables may be of another release than Python's.
UNSAFE = re.compile("[^\x00-ԯẠ-ỹ‐-‧‰-⁞₠-₿ぁ-ゖァ-ヺ一-龥가-힣]")
SIGMA = "Σ"


def byte_characters() -> list[str]:
    """The character that stands for each byte in a vocabulary: printable ones for themselves, others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class _Cache(dict):
    def __init__(self, vocabulary):
        self.vocabulary, self.left = vocabulary, CACHE_BYTES

    def __missing__(self, word):
        ids = np.array(self.vocabulary.word_ids(word.encode()), np.int32).tobytes()
        cost = 200 + 4 * len(word) + len(ids)
        if cost > CACHE_BYTES // 8:
            return ids
        if cost > self.left:  # the older half leaves; frequent words come back at once
            for old in list(islice(self, len(self) // 2 + 1)):
                self.left += 200 + 4 * len(old) + len(self.pop(old))
        self.left -= cost
        self[word] = ids
        return ids


class Vocabulary:
    """Tables of one vocabulary file of byte-level BPE (JSON), with or without a suffix at the end of words."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, self.source = spec["model"], source
        if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE files are read")
        ids = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        letters = byte_characters()
        self.inner = [ids[c] for c in letters]
        self.last = [ids[c + suffix] for c in letters]
        self.whole = {w: i for w, i in ids.items()} if model.get("ignore_merges") else {}
        self.letters = letters
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 24 | ids[b]] = rank << 24 | ids[a + b]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("special tokens must stand for themselves alone")
        self.special = {k: np.array([v], np.int32).tobytes() for k, v in special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        steps = _flat(spec.get("normalizer"), "normalizers")
        known = {"NFC", "Lowercase", "Replace"}
        if any(s["type"] not in known or s["type"] == "Replace" and s["pattern"] != {"Regex": "\\s+"} for s in steps):
            raise ValueError(f"normalizers other than {sorted(known)} are not read")
        self.nfc, self.lower = (any(s["type"] == k for s in steps) for k in ("NFC", "Lowercase"))
        split = _flat(spec["pre_tokenizer"], "pretokenizers")
        own = [s for s in split if s["type"] == "Split"]
        if any(s.get("add_prefix_space") for s in split) or bool(own) == any(s.get("use_regex", True) for s in split if s["type"] == "ByteLevel"):
            raise ValueError("words are split by one pattern, without a space before the text")
        if own and (own[0]["behavior"] != "Removed" or not own[0]["invert"]):
            raise ValueError("the pattern must match words")
        if not own and any(s["type"] == "Replace" for s in steps):
            raise ValueError("white space is replaced only where words have none")
        pattern = own[0]["pattern"]["Regex"] if own else BYTE_LEVEL
        self.pattern = regex.compile(pattern)
        # the same over ASCII: spelled out classes, for the faster engine
        plain = pattern.replace(r"[\p{L}]", "[a-zA-Z]").replace(r"[\p{N}]", "[0-9]").replace(r"[^\s\p{L}\p{N}]", r"[^ \t-\ra-zA-Z0-9]")
        plain = plain.replace(r"\p{L}", "[a-zA-Z]").replace(r"\p{N}", "[0-9]").replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]")
        self.ascii = re.compile(plain)
        size = 1 + max([*ids.values(), *special.values()])
        self.tokens: list[str | None] = [None] * size
        for w, i in [*ids.items(), *special.items()]:
            self.tokens[i] = w
        self.joined = spec.get("decoder") is None  # tokens with a space between them; else the bytes they stand for
        if not self.joined and spec["decoder"]["type"] != "ByteLevel":
            raise ValueError("the decoder must be that of bytes, or none")
        self.cache = _Cache(self)
        self._library = None

    # ---- encoding

    def words(self, text: str) -> list[str]:
        """The normalised words of a text without special tokens."""
        if text.isascii():
            return self.ascii.findall(text.lower() if self.lower else text)
        if UNSAFE.search(text):
            if self._library is None:
                import tokenizers

                self._library = tokenizers.Tokenizer.from_str(self.source)
            n = self._library.normalizer
            text = n.normalize_str(text) if n is not None else text
            return [text[a:b] for _, (a, b) in self._library.pre_tokenizer.pre_tokenize_str(text)]
        if self.nfc:
            text = unicodedata.normalize("NFC", text)
        if self.lower:
            text = "".join(map(str.lower, text)) if SIGMA in text else text.lower()
        return self.pattern.findall(text)

    def encode(self, text: str) -> bytes:
        """Ids of a text as the bytes of 32-bit integers."""
        get = self.cache.__getitem__
        if self.cut is None or not any(t in text for t in self.special):
            return b"".join(map(get, self.words(text)))
        out = []
        for piece in self.cut.split(text):
            out += [self.special[piece]] if piece in self.special else map(get, self.words(piece))
        return b"".join(out)

    def word_ids(self, word: bytes) -> list[int]:
        if not word:
            return []
        if self.whole and (i := self.whole.get("".join(self.letters[b] for b in word))) is not None:
            return [i]
        ids = [self.inner[b] for b in word]
        ids[-1] = self.last[word[-1]]
        return self._scan(ids) if len(ids) <= SHORT else self._heap(ids)

    def _scan(self, ids: list[int]) -> list[int]:
        """``ids`` are the parts between boundaries, ``ranks[i]`` is the rank of the pair across boundary i (with the id it makes)."""
        get = self.merges.get
        ranks = [get(a << 24 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while ranks and (low := min(ranks)) < NONE:
            i = ranks.index(low)
            ids[i] = low & 0xFFFFFF
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(ids[i] << 24 | ids[i + 1], NONE)
            if i:
                ranks[i - 1] = get(ids[i - 1] << 24 | ids[i], NONE)
        return ids

    def _heap(self, ids: list[int]) -> list[int]:
        """The same for long words: pairs wait in a heap by rank and place; one whose parts have changed is passed over."""
        merges, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        wait = []

        def add(i):
            j = after[i]
            if j >= 0 and (m := merges.get(ids[i] << 24 | ids[j])) is not None:
                heapq.heappush(wait, (m >> 24, i, ids[i], ids[j], m & 0xFFFFFF))

        for i in range(n - 1):
            add(i)
        while wait:
            _, i, a, b, made = heapq.heappop(wait)
            j = after[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            if before[i] >= 0:
                add(before[i])
            add(i)
        return [x for x in ids if x >= 0]

    # ---- decoding

    def decode(self, flat: pa.Array, offsets: np.ndarray) -> pa.Array:
        """Texts of id lists; ``offsets`` bound each list in ``flat``."""
        size = len(self.tokens)
        ids = pc.fill_null(flat.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        known = np.fromiter((t is not None for t in self.tokens), bool, size)
        good = (ids >= 0) & (ids < size)
        good[good] = known[ids[good]]
        if not good.all():
            offsets = np.concatenate(([0], np.cumsum(good)))[offsets]
            ids = ids[good]
        if self.joined:
            names = pa.array([t or "" for t in self.tokens], pa.large_string())
            lists = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), names.take(pa.array(ids)))
            return pc.binary_join(lists, pa.scalar(" ", pa.large_string())).cast(pa.large_string())
        value = {c: b for b, c in enumerate(self.letters)}
        raw = [bytes(value[c] for c in t) if all(c in value for c in t) else t.encode() for t in (t or "" for t in self.tokens)]
        return pa.array([b"".join(map(raw.__getitem__, ids[a:b])).decode("utf-8", "replace") for a, b in zip(offsets, offsets[1:], strict=False)], pa.large_string())


def _flat(step, key):
    if step is None:
        return []
    return [s for x in step[key] for s in _flat(x, key)] if step["type"] == "Sequence" else [step]


@lru_cache(maxsize=2)
def vocabulary(source: str) -> Vocabulary:
    """Tables are built once in a worker."""
    return Vocabulary(source)


def _with(df: DataFrame, name: str, kind: S.DataType) -> tuple[DataFrame, S.StructType]:
    """``df`` without the column that is replaced, and the schema with the new one."""
    kept = df.select(*[df[f"`{c}`"] for c in df.columns if c.lower() != name.lower()])
    return kept, S.StructType([*kept.schema.fields, S.StructField(name, kind)])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of the ids of each whole text by the vocabulary at ``path``."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    kept, schema = _with(docs, ids, S.ArrayType(S.IntegerType(), False))

    def run(batches):
        v = vocabulary(source)
        for rows, data, off in T.text_blocks(batches, text):
            got = [v.encode(data[off[i] : off[i + 1]].tobytes().decode("utf-8", "replace")) for i in range(rows.num_rows)]
            bounds = np.concatenate(([0], np.cumsum([len(g) // 4 for g in got])))
            flat = pa.array(np.frombuffer(b"".join(got), np.int32))
            yield _append(rows, pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), flat), ids)

    return kept.mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``encoded`` with a column of the text of each array of ids; special tokens are kept."""
    with open(path, encoding="utf-8") as f:
        source = f.read()
    kept, schema = _with(encoded, text, S.StringType())

    def run(batches):
        v = vocabulary(source)
        for batch in batches:
            lists = batch.column(ids)
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            off = np.concatenate(([0], np.cumsum(lengths)))
            flat = lists.flatten()
            i = 0
            while i < batch.num_rows:  # blocks of ids, or one row
                j = min(batch.num_rows, max(i + 1, int(np.searchsorted(off, off[i] + T.BLOCK_BYTES // 4, "right")) - 1))
                texts = v.decode(flat.slice(off[i], off[j] - off[i]), off[i : j + 1] - off[i])
                yield _append(batch.slice(i, j - i), texts.cast(pa.string()), text)
                i = j

    return kept.mapInArrow(run, schema)


def _append(rows: pa.RecordBatch, column: pa.Array, name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*rows.columns, column], names=[*rows.schema.names, name])


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    both = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text"), path)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
