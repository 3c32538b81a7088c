"""BPE encoding by tree concatenation, and decoding.

A text above ``leaf`` code points is halved until its parts are short enough;
each leaf is encoded as a text of its own: leaves of a text up to ``spread`` code
points where the text is read, those of longer ones in parallel, as rows of their
own. Two neighbours
are then concatenated: a window around their join is encoded again and grown
until it shares a whole token with each side at the same place. The left side
up to its shared token, the window between the two, and the right side from its
shared token on are the encoding of both: a sequence of tokens is the encoding
of its text where each two neighbouring tokens are, and each pair there is one
that the left, the window or the right has made. The tree ends with the text.

Shorter texts are single leaves and are encoded where they are read, without a
shuffle. Within a leaf, encodings of its words are remembered by worker:
no merge crosses them. Plain Latin-1 text is lowered and split here as the
tokenizer would and its words go to the tokenizer's model; any other text goes to
the whole tokenizer in runs between blanks.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

LEAF, SPREAD, WINDOW, END, KNOWN, LONGEST = 8192, 65536, 64, 128, 150_000, 64
_BLANKS = " \n\t\r"
_RUN = re.compile(r"[^ \t\n\r]+")
#: In Latin-1 text that is lower-cased: contractions, letters, single numbers, other marks.
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^a-z0-9\\s\xaa\xb5\xba\xdf-\xf6\xf8-\xff\xb2\xb3\xb9\xbc-\xbe]+")
_PLAIN = bytes([*b"\t\n\r", *range(32, 127), *range(0xA1, 0xAD), *range(0xAE, 256)])


def load(tokenizer: str):
    """The tokenizer in a file, or in a file of public_tokenizers of that name; truncation and padding off."""
    from tokenizers import Tokenizer

    if os.sep not in tokenizer:
        import public_tokenizers

        tokenizer = public_tokenizers.path(tokenizer)
    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    return t


def _between_blanks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _is_plain(text: str) -> bool:
    """Whether a text is of letters, marks and blanks that Python lowers and splits as the tokenizer does, without special tokens."""
    try:
        return not text.encode("latin-1").translate(None, _PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class Known(dict):
    """Encodings of parts, made by encode for many at a time. Short ones are kept, KNOWN of them and as many older ones."""

    def __init__(self, encode: Callable[[list[str]], list]):
        super().__init__()
        self.encode, self.old = encode, {}

    def learn(self, parts: Iterable[str]) -> None:
        new = [x for x in set(parts) if x not in self]
        if len(self) + len(new) > KNOWN:
            self.old = {k: v for k, v in self.items() if len(k) <= LONGEST}
            self.clear()
        ask = [x for x in new if x not in self.old]
        self.update((x, self.old[x]) for x in new if x in self.old)
        self.update(zip(ask, self.encode(ask), strict=True))

    def __missing__(self, part: str):
        got = self[part] = self.old[part] if part in self.old else self.encode([part])[0]
        return got


def _model_ids(t) -> Callable[[list[str]], list[list[int]]]:
    """What the tokenizer's own model makes of plain parts: they are lower-cased and split already, and only their bytes have yet to be written as the model's letters."""
    from tokenizers.pre_tokenizers import ByteLevel

    letters = ByteLevel(add_prefix_space=False, use_regex=False)
    table = {c: letters.pre_tokenize_str(chr(c))[0][0] for c in _PLAIN if c > 32}
    tokenize = t.model.tokenize
    return lambda parts: [[x.id for x in tokenize(p.translate(table))] for p in parts]


_worker: dict[str, tuple] = {}


def _tools(tokenizer: str) -> tuple:
    """This worker's tokenizer, and the encodings that it knows: ids, and ids with offsets."""
    if tokenizer not in _worker:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = load(tokenizer)
        ids = Known(_model_ids(t))
        ids.runs = Known(lambda parts: [x.ids for x in t.encode_batch_fast(parts, add_special_tokens=False)])
        placed = Known(lambda parts: [(x.ids, [a for a, _ in x.offsets], [b for _, b in x.offsets]) for x in t.encode_batch(parts, add_special_tokens=False)])
        _worker[tokenizer] = t, ids, placed
    return _worker[tokenizer]


def leaf_ids(texts: list[str], known: Known) -> list[list[int]]:
    """The ids of each text."""
    of = [known if _is_plain(x) else known.runs for x in texts]
    parts = [_SPLIT.findall(x.lower()) if k is known else _between_blanks(x) for x, k in zip(texts, of, strict=True)]
    for store in (known, known.runs):
        store.learn(chain.from_iterable(x for x, k in zip(parts, of, strict=True) if k is store))
    return [list(chain.from_iterable(map(k.__getitem__, x))) for x, k in zip(parts, of, strict=True)]


def ids_of(texts: list[str], leaf: int, known: Known, placed: Known) -> list[list[int]]:
    """The ids of each text, of those above leaf by their tree."""
    short = iter(leaf_ids([x for x in texts if len(x) <= leaf], known))
    out: list[list[int]] = []
    for x in texts:
        if len(x) <= leaf:
            out.append(next(short))
            continue
        cuts, encode = cuts_of(len(x), leaf), lambda s: placed_tokens(s, placed)
        ids = _by_ends(x, cuts, known, placed, encode) if leaf >= 4 * END else None
        if ids is None:
            leaves = [encode(x[a:b]) + np.array([[0], [a], [a]]) for a, b in zip(cuts, cuts[1:], strict=False)]
            ids = concatenated(x, cuts, leaves, encode)[0].tolist()
        out.append(ids)
    return out


@dataclass
class Node:
    """The ids of text[begin:end], and the tokens of its first and last END code points or more, placed in the text."""

    begin: int
    end: int
    ids: list[int]
    head: np.ndarray
    tail: np.ndarray


def _leaf(text: str, begin: int, end: int, known: Known, placed: Known) -> Node:
    piece = text[begin:end]
    plain = _is_plain(piece)
    words = _SPLIT.findall(piece.lower()) if plain else [x for x in _between_blanks(piece) if x]
    store = known if plain else known.runs
    store.learn(words)
    ends = []
    for forward in (True, False):
        found, at = [], 0 if forward else len(piece)
        for w in words if forward else reversed(words):
            if (at if forward else len(piece) - at) > END:
                break
            while piece[at if forward else at - 1] in _BLANKS:
                at += 1 if forward else -1
            at -= 0 if forward else len(w)
            found.append((begin + at, w))
            at += len(w) if forward else 0
        ends.append(_placed(found if forward else found[::-1], placed))
    return Node(begin, end, list(chain.from_iterable(map(store.__getitem__, words))), *ends)


def _by_ends(text: str, cuts: list[int], known: Known, placed: Known, encode: Callable[[str], np.ndarray]) -> list[int] | None:
    """What concatenated() gives where all sides agree within END code points of their joins, with only the tokens there placed; else None."""
    nodes = [_leaf(text, a, b, known, placed) for a, b in zip(cuts, cuts[1:], strict=False)]
    while len(nodes) > 1:
        pairs = []
        for left, right in zip(nodes[::2], nodes[1::2], strict=False):
            middle, window = left.end, WINDOW
            while True:
                a, b = middle - window, middle + window
                seen = encode(text[a:b]) + np.array([[0], [a], [a]])
                l, r = _common(left.tail, seen, a + 1, middle - 1), _common(right.head, seen, middle + 1, b - 1)
                if len(l) and len(r):
                    break
                window *= 2
                if window > END:
                    return None
            kept = len(left.ids) - left.tail.shape[1] + int(l[-1, 0]) + 1
            pairs.append(Node(left.begin, right.end, left.ids[:kept] + seen[0, l[-1, 1] + 1 : r[0, 1]].tolist() + right.ids[r[0, 0] :], left.head, right.tail))
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0].ids


def placed_tokens(text: str, known: Known) -> np.ndarray:
    """Rows of id, start and end of a text."""
    return _placed([(m.start(), m[0]) for m in (_SPLIT.finditer(text.lower()) if _is_plain(text) else _RUN.finditer(text))], known)


def _placed(found: list[tuple[int, str]], known: Known) -> np.ndarray:
    """Rows of id, start and end of words at their starts."""
    if not found:
        return np.zeros((3, 0), dtype=np.int64)
    known.learn(x for _, x in found)
    got = [known[x] for _, x in found]
    n = [len(x[0]) for x in got]
    base = np.repeat([a for a, _ in found], n)
    flat = [np.fromiter(chain.from_iterable(x[i] for x in got), dtype=np.int64, count=sum(n)) for i in range(3)]
    return np.stack([flat[0], flat[1] + base, flat[2] + base])


def _common(side: np.ndarray, window: np.ndarray, low: int, high: int) -> np.ndarray:
    """Places in side and window of equal tokens within [low, high] that stand alone there: no other token shares their text."""

    def alone(x: np.ndarray) -> np.ndarray:
        before = np.concatenate([[True], x[1, 1:] >= x[2, :-1]])
        return before & np.concatenate([before[1:], [True]]) & (x[1] >= low) & (x[2] <= high) & (x[2] > x[1])

    i = np.searchsorted(side[2], [low, high + 1])
    near = side[:, i[0] : i[1] + 1]
    a, b = np.flatnonzero(alone(near)), np.flatnonzero(alone(window))
    keys = {tuple(near[:, k]): k for k in a}
    return np.array([(keys[t] + i[0], k) for k in b if (t := tuple(window[:, k])) in keys], dtype=np.int64).reshape(-1, 2)


def joined(left: np.ndarray, right: np.ndarray, text: str, begin: int, middle: int, end: int, encode: Callable[[str], np.ndarray], window: int = WINDOW) -> np.ndarray:
    """The tokens of text[begin:end] from those of its parts before and after middle; encode gives a string's tokens."""
    while True:
        a, b = max(begin, middle - window), min(end, middle + window)
        if a == begin and b == end:
            return encode(text[a:b]) + np.array([[0], [a], [a]])
        seen = encode(text[a:b]) + np.array([[0], [a], [a]])
        # A token at a cut end of the window may be another one in the text.
        l = _common(left, seen, a + (a > begin), middle - 1) if a > begin else None
        r = _common(right, seen, middle + 1, b - (b < end)) if b < end else None
        if (l is None or len(l)) and (r is None or len(r)):
            head, i = (left[:, : l[-1, 0] + 1], l[-1, 1] + 1) if l is not None else (left[:, :0], 0)
            tail, j = (right[:, r[0, 0] :], r[0, 1]) if r is not None else (right[:, :0], seen.shape[1])
            return np.concatenate([head, seen[:, i:j], tail], axis=1)
        window *= 2


def cuts_of(n: int, leaf: int) -> list[int]:
    """Where a text of n code points is cut by halving its parts until none is above leaf."""
    parts = 1
    while n > leaf * parts:
        parts *= 2
    return [n * i // parts for i in range(parts + 1)]


def concatenated(text: str, cuts: list[int], leaves: list[np.ndarray], encode: Callable[[str], np.ndarray]) -> np.ndarray:
    """The tokens of a text from those of its leaves in order (placed in the text), joined pairwise up a tree."""
    nodes = list(zip(cuts, cuts[1:], leaves, strict=False))
    while len(nodes) > 1:
        pairs = [(a, c, joined(x, y, text, a, b, c, encode)) for (a, b, x), (_, c, y) in zip(nodes[::2], nodes[1::2], strict=False)]
        nodes = pairs + nodes[len(pairs) * 2 :]
    return nodes[0][2]


def _lists(values: list[list[int] | np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.fromiter(chain.from_iterable(values), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _speaker(t) -> Callable[[list[int]], str]:
    """What decodes a list of ids."""
    if t.decoder is not None:
        return lambda ids: t.decode(ids, skip_special_tokens=False)
    names = [t.id_to_token(i) for i in range(t.get_vocab_size())]
    return lambda ids: " ".join(map(names.__getitem__, ids))  # the library then joins the tokens by blanks


def encode(docs: DataFrame, keep: list[str], text: str = "text", tokenizer: str = "word_bpe_49k.json", leaf: int = LEAF, spread: int = SPREAD, decoded: bool = False) -> DataFrame:
    """The columns keep of every row of docs, and ids: the tokens of its whole text (null: empty), special tokens added nowhere.

    decoded adds the ids' decoding as column decoded, made by the worker that has
    them: as decode() would, without a second Python worker to each task.

    The tokenizer's merges must not cross white space (a file of which that
    isn't so needs another split). Repeated rows each come back, and no rows give
    none. Other columns of docs may have any names. A text above spread is a row
    like any other whose leaves are spread; as its text and its tokens are single
    values, each must fit Spark's limit of 2 GB a value.
    """
    names = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(*(F.col(c).alias(n) for c, n in zip(keep, names, strict=True)), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kept = T.StructType([f for f in rows.schema.fields if f.name in names])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known, placed = _tools(tokenizer)
        say = _speaker(t)
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                ids = ids_of(b.column("text").to_pylist(), leaf, known, placed)
                said = [pa.array(map(say, ids), pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), _lists(ids), *said], made)

    made = [*names, "ids", *["decoded"] * decoded]
    ids_type = T.StructType([*kept.fields, T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded])
    spread = max(spread, leaf)
    done = rows.filter(F.length("text") <= spread).mapInArrow(short, ids_type)

    halves = F.pow(F.lit(2), F.ceil(F.log2(F.length("text") / leaf))).cast("int")
    long = rows.filter(F.length("text") > spread).withColumn("row", F.monotonically_increasing_id()).withColumn("n", halves)
    long = long.select(*names, "row", "n", "text", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("leaf"))
    cut = lambda i: F.floor(F.length("text").cast("long") * i / F.col("n")).cast("int")
    long = long.withColumn("text", F.substring("text", cut(F.col("leaf")) + 1, cut(F.col("leaf") + 1) - cut(F.col("leaf"))))
    long = long.select(*names, "row", "leaf", "text").repartition("row", "leaf")

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, known = _tools(tokenizer)
        for whole in batches:
            for i in range(0, whole.num_rows, 16):
                b = whole.slice(i, 16)
                got = [placed_tokens(x, known) for x in b.column("text").to_pylist()]
                cols = [pa.array([x[k].astype(np.int32).tobytes() for x in got], pa.binary()) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, "id", "at", "to"])

    leaf_type = T.StructType([*long.schema.fields, *(T.StructField(c, T.BinaryType()) for c in ("id", "at", "to"))])

    def merge(group: pa.Table) -> pa.Table:
        t, _, known = _tools(tokenizer)
        group = group.sort_by("leaf")
        parts = group.column("text").to_pylist()
        cuts = [0, *accumulate(map(len, parts))]
        leaves = []
        for at, *cols in zip(cuts, *(group.column(c).to_pylist() for c in ("id", "at", "to")), strict=False):
            tokens = np.stack([np.frombuffer(c, dtype=np.int32) for c in cols]).astype(np.int64)
            leaves.append(tokens + np.array([[0], [at], [at]]))
        ids = concatenated("".join(parts), cuts, leaves, lambda s: placed_tokens(s, known))[0]
        said = [pa.array([_speaker(t)(ids.tolist())], pa.string())] if decoded else []
        return pa.table([*(group.column(n).slice(0, 1) for n in names), _lists([ids]), *said], names=made)

    merged = long.mapInArrow(leaves, leaf_type).groupBy("row").applyInArrow(merge, ids_type)
    out = done.unionByName(merged)
    return out.select(*(F.col(n).alias(c) for c, n in zip(keep, names, strict=True)), *made[len(names) :])


def decode(ids: Column, tokenizer: str = "word_bpe_49k.json") -> Column:
    """The text of token ids, special tokens included; null for null, empty for none."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        say = _speaker(load(tokenizer))
        for s in batches:
            yield pd.Series([None if x is None else say(x.tolist()) for x in s], dtype=object)

    return text(ids)


def digest(docs: DataFrame, tokenizer: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row."""
    got = encode(docs, ["doc_id"], tokenizer=tokenizer, decoded=True)
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens and their decoding, as digests."""
    return digest(table(spark, sf_dir, "documents"))
