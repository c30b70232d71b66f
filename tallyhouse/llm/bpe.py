"""BPE encoding and decoding with a public vocabulary; long text by tree concatenation.

Text longer than ``piece_chars`` is cut into pieces that Spark encodes in parallel; every
join is then mended: the words around the cut are read again until both sides agree on a
word boundary. A single word that is long itself is halved in the same way, down to short
leaves, and windows of tokens around each join are re-encoded, twice as wide each time,
until the window's first and last tokens are those of the two sides. Adjacent tokens that
occur next to each other in a correct encoding stay correct next to each other, so the
result is the library's own, token by token.

Nulls encode to no ids, empty texts too. Every row is encoded by itself: repeated rows give
repeated results. Other columns pass through untouched; a column named like the result is
replaced.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.llm.common import append_array, free_name, give_back, row_slices, text_slices, with_field

# Words up to this many characters go to the library in one call.
LEAF_CHARS = 256
# Texts beyond this are encoded in pieces.
PIECE_CHARS = 1 << 16
# Words remembered per worker before the memory starts anew.
MEMORY_WORDS = 250_000
# Characters worked on between two emitted batches.
BATCH_CHARS = 1_000_000
# The vocabulary's special strings and the character classes of its word
# pattern within Latin-1, lower case.
SPECIALS = re.compile(r"(<\|startoftext\|>|<\|endoftext\|>)")
LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]"
    "|[^a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe\t-\r \x85\xa0]+"
)


def public_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """One worker's tokenizer with a bounded memory of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"]["end_of_word_suffix"]
        self.path = path
        self.special = {t["content"]: np.int32(t["id"]).tobytes() for t in spec["added_tokens"]}
        size = self.whole.get_vocab_size()
        self.strings = np.array([self.whole.id_to_token(i) or "" for i in range(size)], dtype=object)
        self.suffix = suffix or ""
        self.bytes = self._byte_letters()
        self.memory: dict[str, bytes] = {}

    @functools.cached_property
    def decimals(self) -> np.ndarray:
        """Every id as decimal text."""
        return np.array([str(i) for i in range(max(len(self.strings), 1 + max(self._special_ids(), default=0)))], dtype=object)

    def _special_ids(self) -> list[int]:
        return [int(np.frombuffer(b, np.int32)[0]) for b in self.special.values()]

    def _bare(self, **model) -> object:
        """The model alone: it sees mapped bytes. Built when the first long word comes."""
        from tokenizers import Tokenizer

        with open(self.path, encoding="utf-8") as f:
            spec = json.load(f)
        spec |= {"normalizer": None, "pre_tokenizer": None, "added_tokens": [], "model": spec["model"] | model}
        return Tokenizer.from_str(json.dumps(spec))

    @functools.cached_property
    def bodies(self) -> list[str]:
        """The vocabulary's strings without the mark of a word's end."""
        return [s.removesuffix(self.suffix) for s in self.strings]

    @functools.cached_property
    def last(self):
        return self._bare()

    @functools.cached_property
    def inner(self):
        """The model that never closes a word."""
        return self._bare(end_of_word_suffix=None)

    def _byte_letters(self) -> list[str]:
        """The letter that stands for each byte: printable ones for themselves, the rest from 256 on."""
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        return [chr(b if b in plain else next(rest)) for b in range(256)]

    # Words of a text -----------------------------------------------------------------

    def normal(self, text: str) -> str:
        """The vocabulary's normal form, apart from runs of white space, which are no words."""
        try:
            text.encode("latin-1")
            return text.lower()
        except UnicodeEncodeError:
            return self.whole.normalizer.normalize_str(text)

    def words(self, text: str) -> list[str]:
        """Words of a text in normal form."""
        try:
            text.encode("latin-1")
            return LATIN_WORDS.findall(text)
        except UnicodeEncodeError:
            return [text[a:b] for _, (a, b) in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of each word of a text in normal form."""
        try:
            text.encode("latin-1")
            return [m.span() for m in LATIN_WORDS.finditer(text)]
        except UnicodeEncodeError:
            return [span for _, span in self.whole.pre_tokenizer.pre_tokenize_str(text)]

    # Ids of words --------------------------------------------------------------------

    def learn(self, words: set[str]) -> None:
        """Put words into the memory."""
        if len(self.memory) + len(words) > MEMORY_WORDS:
            self.memory.clear()
        short = [w for w in words if len(w) <= LEAF_CHARS]
        for w, e in zip(short, self.whole.encode_batch_fast(short, add_special_tokens=False), strict=True):
            self.memory[w] = np.array(e.ids, dtype=np.int32).tobytes()
        for w in words:
            if len(w) > LEAF_CHARS:
                self.memory[w] = np.array(self.long_word(w), dtype=np.int32).tobytes()

    def long_word(self, word: str, leaf: int = LEAF_CHARS) -> list[int]:
        """Ids of a word of any length, by halving and mending the joins."""
        letters = "".join([self.bytes[b] for b in word.encode()])
        return self._halves(letters, 0, len(letters), leaf)

    def _encode(self, letters: str, closed: bool) -> list[int]:
        return (self.last if closed else self.inner).encode(letters, add_special_tokens=False).ids

    def _halves(self, letters: str, a: int, b: int, leaf: int) -> list[int]:
        if b - a <= leaf:
            return self._encode(letters[a:b], b == len(letters))
        mid = (a + b) // 2
        return self._mend(self._halves(letters, a, mid, leaf), self._halves(letters, mid, b, leaf), b == len(letters))

    def _mend(self, left: list[int], right: list[int], closed: bool) -> list[int]:
        """One encoding out of two neighbours', by windows that grow until both sides agree."""
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            text = "".join([self.bodies[i] for i in (*left[a:], *right[:b])])
            ids = self._encode(text, closed and b == len(right))
            left_ok = a == 0 or ids[0] == left[a]
            right_ok = b == len(right) or ids[-1] == right[b - 1]
            if left_ok and right_ok:
                return [*left[:a], *ids, *right[b:]]
            width *= 2

    # Whole texts ---------------------------------------------------------------------

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as packed 32-bit integers."""
        parts = [SPECIALS.split(t) if "<|" in t else [t] for t in texts]
        lists = [[(p,) if p in self.special else self.words(self.normal(p)) for p in ps if p] for ps in parts]
        known = self.memory
        new = {w for ls in lists for ws in ls if type(ws) is list for w in ws if w not in known}
        if new:
            before = set()
            if len(known) + len(new) > MEMORY_WORDS:
                before = {w for ls in lists for ws in ls if type(ws) is list for w in ws}
            self.learn(new | before)
        out = []
        for ls in lists:
            chunks = [b"".join([known[w] for w in ws]) if type(ws) is list else self.special[ws[0]] for ws in ls]
            out.append(chunks[0] if len(chunks) == 1 else b"".join(chunks))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: the library joins this vocabulary's pieces by blanks; ids outside it are left out."""
        known = ids[(ids >= 0) & (ids < len(self.strings))]
        return " ".join(self.strings[known].tolist())


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """A worker's tokenizer. Tasks ask for it when their first batch comes: many have none."""
    made = Encoder(path)
    give_back()
    return made


def _lists(chunks: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *[len(c) // 4 for c in chunks]]).astype(np.int32)
    values = np.frombuffer(b"".join(chunks), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _encode_rows(df: DataFrame, text_col: str, out: str, path: str) -> DataFrame:
    schema = with_field(df, out, T.ArrayType(T.IntegerType()))
    keep = schema.names[:-1]

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            for a, b, texts in text_slices(batch.column(batch.schema.get_field_index(text_col)), BATCH_CHARS):
                yield append_array(batch.slice(a, b - a), keep, out, _lists(enc.encode(texts)))
        give_back()

    return df.mapInArrow(run, schema)


def _encode_long(texts: DataFrame, path: str, piece_chars: int) -> DataFrame:
    """(key, ids) of long texts: normal form, pieces, parallel encoding, mended joins."""

    def normalise(batches):
        for batch in batches:
            enc = encoder(path)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([enc.normal(t) for t in batch.column(1).to_pylist()], pa.string())],
                names=["key", "text"],
            )

    def pieces(batches):
        for batch in batches:
            enc = encoder(path)
            texts = batch.column(2).to_pylist()
            for i, text in enumerate(texts):
                spans = enc.spans(text)
                words = [text[a:b] for a, b in spans]
                if new := {w for w in words if w not in enc.memory}:
                    enc.learn(new | set(words) if len(enc.memory) + len(new) > MEMORY_WORDS else new)
                ids = [enc.memory[w] for w in words]
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays(
                    [*row.columns, pa.array([[a for a, _ in spans]], pa.list_(pa.int32())),
                     pa.array([[len(x) // 4 for x in ids]], pa.list_(pa.int32())), _lists([b"".join(ids)])],
                    names=["key", "no", "text", "starts", "counts", "ids"],
                )

    def join(key, group):
        enc = encoder(path)
        rows = group.sort_values("no")
        nodes = [
            Piece(t, np.asarray(s, np.int64), np.asarray(c, np.int64), np.asarray(i, np.int32))
            for t, s, c, i in zip(rows["text"], rows["starts"], rows["counts"], rows["ids"], strict=True)
        ]
        while len(nodes) > 1:
            pairs = [nodes[i : i + 2] for i in range(0, len(nodes), 2)]
            nodes = [concat(enc, *p) if len(p) == 2 else p[0] for p in pairs]
        import pandas as pd

        return pd.DataFrame({"key": [key[0]], "ids": [nodes[0].ids]})

    n = F.ceil(F.length("text") / piece_chars).cast("int")
    cut = F.explode(F.sequence(F.lit(0), n - 1))
    parts = (
        texts.mapInArrow(normalise, "key string, text string")
        .filter(F.length("text") > 0)
        .select("key", "text", cut.alias("no"))
        .select("key", "no", F.expr(f"substr(text, no * {piece_chars} + 1, {piece_chars})").alias("text"))
        .repartition("key", "no")
    )
    encoded = parts.mapInArrow(pieces, "key string, no int, text string, starts array<int>, counts array<int>, ids array<int>")
    return encoded.groupBy("key").applyInPandas(join, "key string, ids array<int>")


class Piece:
    """Encoded text: where its words start, how many ids each has, and the ids."""

    def __init__(self, text: str, starts: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.text, self.starts, self.counts, self.ids = text, starts, counts, ids


def concat(enc: Encoder, left: Piece, right: Piece, window: int = 64) -> Piece:
    """Join two pieces: words from the last start before the cut are read again, over more and
    more of the right side, until one ends at a start that the right side has as well."""
    cut = len(left.text)
    if not len(left.starts):
        shifted = right.starts + cut
        return Piece(left.text + right.text, shifted, right.counts, right.ids)
    start = int(left.starts[-1])
    ahead = set()
    while True:
        view = left.text[start:] + right.text[:window]
        full = window >= len(right.text)
        spans = [(a + start, b + start) for a, b in enc.spans(view)]
        ahead = set(right.starts[right.starts < window].tolist())
        # The last word of a view that is not the whole may go on beyond it.
        sure = spans if full else spans[:-1]
        meet = next((i for i, (a, _) in enumerate(sure) if a >= cut and a - cut in ahead), None)
        if meet is not None or full:
            break
        window *= 2
    redone = sure if meet is None else sure[:meet]
    skip = len(right.starts) if meet is None else int(np.searchsorted(right.starts, sure[meet][0] - cut))
    words = [(left.text[start:] + right.text)[a - start : b - start] for a, b in redone]
    enc.learn({w for w in words if w not in enc.memory} or set())
    packed = [enc.memory[w] if w in enc.memory else np.array(enc.long_word(w), np.int32).tobytes() for w in words]
    middle = np.frombuffer(b"".join(packed), dtype=np.int32)
    keep = len(left.ids) - int(left.counts[-1])
    drop = int(right.counts[:skip].sum())
    return Piece(
        left.text + right.text,
        np.concatenate([left.starts[:-1], np.array([a for a, _ in redone], np.int64), right.starts[skip:] + cut]),
        np.concatenate([left.counts[:-1], np.array([len(p) // 4 for p in packed], np.int64), right.counts[skip:]]),
        np.concatenate([left.ids[:keep], middle, right.ids[drop:]]),
    )


def _in_pieces(text_col: str, piece_chars: int) -> Column:
    """Whether a text is encoded in pieces: it is long and holds no special string."""
    special = F.coalesce(F.col(text_col).contains("<|"), F.lit(False))
    return F.coalesce(F.length(text_col) > piece_chars, F.lit(False)) & ~special


def encode(
    df: DataFrame, path: str, text_col: str = "text", out_col: str = "ids", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """``df`` with the ids of ``text_col``, as the library gives them without special tokens added.

    Texts of up to ``piece_chars`` characters are encoded where they lie, without a shuffle.
    Longer distinct texts are encoded in pieces and joined back by their SHA-256; those that
    hold a special string are encoded in one go, as that string is read before all else.
    """
    df = df.drop(out_col) if out_col in df.columns else df
    long = _in_pieces(text_col, piece_chars)
    short_rows = _encode_rows(df.filter(~long), text_col, out_col, path)
    return short_rows.unionByName(_long_rows(df.filter(long), text_col, out_col, path, piece_chars))


def _long_rows(df: DataFrame, text_col: str, out_col: str, path: str, piece_chars: int) -> DataFrame:
    """``df`` with the ids of texts that are all encoded in pieces."""
    key = free_name(df.columns, "text_key")
    rest = df.withColumn(key, F.sha2(text_col, 256))
    texts = rest.select(F.col(key).alias("key"), F.col(text_col).alias("text")).dropDuplicates(["key"])
    ids = _encode_long(texts, path, piece_chars).select(F.col("key").alias(key), F.col("ids").alias(out_col))
    empty = F.coalesce(out_col, F.array().cast("array<int>")).alias(out_col)
    return rest.join(ids, key, "left").select(*df.columns, empty)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids_col``, special ids included; null ids give an empty text."""
    df = df.drop(out_col) if out_col in df.columns else df
    schema = with_field(df, out_col, T.StringType())
    keep = schema.names[:-1]

    def run(batches):
        for batch in batches:
            enc = encoder(path)
            column = batch.column(batch.schema.get_field_index(ids_col))
            sizes = [n or 0 for n in pa.compute.list_value_length(column).to_pylist()]
            for a, b in row_slices(sizes, BATCH_CHARS // 4):
                rows = [column[i].values for i in range(a, b)]
                texts = ["" if r is None else enc.decode(r.to_numpy(zero_copy_only=False)) for r in rows]
                yield append_array(batch.slice(a, b - a), keep, out_col, pa.array(texts, pa.string()))

    return df.mapInArrow(run, schema)


def digests(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS
) -> DataFrame:
    """Per document: number of ids and SHA-256 of its ids and of the decoded text.

    One worker encodes, decodes and hashes, so ids and decoded texts never leave it; only
    those of long texts come joined from their pieces.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    long = _in_pieces("text", piece_chars)

    def hashed(enc: Encoder, batch: pa.RecordBatch, lists: Iterable[np.ndarray]) -> pa.RecordBatch:
        size, of_ids, of_text = [], [], []
        for ids in lists:
            size.append(len(ids))
            of_ids.append(hashlib.sha256(" ".join(enc.decimals[ids].tolist()).encode()).hexdigest())
            of_text.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
        columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    def of_texts(batches):
        for batch in batches:
            enc = encoder(path)
            for a, b, texts in text_slices(batch.column(1), BATCH_CHARS):
                yield hashed(enc, batch.slice(a, b - a), (np.frombuffer(c, np.int32) for c in enc.encode(texts)))
        give_back()

    def of_ids(batches):
        for batch in batches:
            enc = encoder(path)
            for i in range(batch.num_rows):
                yield hashed(enc, batch.slice(i, 1), [batch.column(1)[i].values.to_numpy(zero_copy_only=False)])
        give_back()

    whole = _long_rows(rows.filter(long), "text", "ids", path, piece_chars).select(F.col("doc_id").cast("long").alias("doc_id"), "ids")
    short = rows.filter(~long).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return short.mapInArrow(of_texts, schema).unionByName(whole.mapInArrow(of_ids, schema))
