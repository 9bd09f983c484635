"""Language-model scores by prediction by partial matching (PPM), with counts of the whole corpus.

The model is a trie of byte contexts of up to ORDER symbols; a text is lower-cased (A-Z), begins after a context of boundary
symbols and ends with one, so the probabilities of all texts come to 1. A symbol is coded in the longest context that was seen. A
context with T symbols, D of them distinct, gives a seen symbol n / (T + D) and the escape to the next shorter one D / (T + D) (escape
method C). There the symbols that the longer context has seen are excluded. Below the empty context all symbols left are alike.

How it runs at any size: no task and no broadcast holds the model.
1. Texts are written in blocks of bounded bytes. Each block asks for its distinct n-grams (a context and the symbol after it, packed
   in a long) and words, with how often its training texts have them. Summed by n-gram or word, these rows are the corpus counts.
2. The n-grams that share the two bytes before the symbol meet in one partition: their subtrees hold all contexts of two and more symbols that
   their code lengths need. Contexts of one symbol and none are at most 257 * 257 counts, which every task gets.
3. Code lengths and word counts are joined back to the blocks that asked. No n-gram or word is hot there: a block asks for each once.
4. A block's answers and then its texts stream through a task, sorted within its partition; each text sums its own.

Adaptive scores (adaptive) need no corpus: each document's trie starts empty and learns symbol by symbol.

Defined results: a null text is empty (one end token, one boundary symbol). Without training texts every token has the base
score log10(0.1 / 0.1) = 0 and every symbol 1 / 257. A row with a null id is a training row. Repeated rows and ids are rows like any other; an
empty table gives no rows; other columns are ignored. Ids are whole numbers or texts of such.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import bounded_batches, save, text_or_empty
from .language_id import held_out

#: Symbols of the longest context.
ORDER = 4
#: Before and after every text.
BOUNDARY = 256
SYMBOLS = 257
#: Bits of a symbol in a packed n-gram.
BITS = 9
#: Bytes of text in a block, and symbols of a text that are packed at once.
BLOCK, SLICE = 1 << 24, 1 << 20

BLOCKS = "block bigint, id string, held_out boolean, packed binary"
ASKED = "block bigint, gram bigint, word string, n bigint"
SCORES = "id string, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def normalised(text: str) -> bytes:
    """UTF-8 with A-Z in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def grams(data: bytes) -> Iterator[np.ndarray]:
    """The packed n-grams of a text, one for each byte and one for its end, in slices of bounded size."""
    symbols = np.frombuffer(data, dtype=np.uint8)
    for lo in range(0, len(symbols) + 1, SLICE):
        hi = min(lo + SLICE, len(symbols) + 1)
        part = symbols[max(0, lo - ORDER) : hi].astype(np.int64)
        before = np.full(ORDER - min(lo, ORDER), BOUNDARY, dtype=np.int64)
        after = np.full(hi - min(hi, len(symbols)), BOUNDARY, dtype=np.int64)
        row = np.concatenate((before, part, after))
        out = np.zeros(hi - lo, dtype=np.int64)
        for k in range(ORDER + 1):
            out = out << BITS | row[k : k + hi - lo]
        yield out


def tokens(data: bytes) -> list[bytes]:
    """Words (bytes.split() parts at the six white-space bytes) and one end, which is the empty word."""
    return [*data.split(), b""]


def in_blocks(docs: DataFrame, held: Column, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """block, id, held_out, packed (the normalised text, by zlib): runs of rows of at most BLOCK characters or one row, written once."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            own = []
            for text in pdf["text"]:
                if size and size + len(text) > BLOCK:
                    block, size = block + 1, 0
                size += len(text) + 1
                own.append(block)
            packed = [zlib.compress(normalised(text), 1) for text in pdf["text"]]
            yield pd.DataFrame({"block": own, "id": pdf["id"], "held_out": pdf["held_out"], "packed": packed})

    rows = docs.select(F.col(id_col).cast("string").alias("id"), held.alias("held_out"), text_or_empty(text_col).alias("text"))
    return save(rows.mapInPandas(run, BLOCKS), "ppm-blocks")


class Asked:
    """The distinct n-grams and words of a block, with their number in its training texts."""

    def __init__(self):
        self.pending: dict[bool, list[np.ndarray]] = {True: [], False: []}
        self.size, self.grams, self.words = 0, (np.empty(0, np.int64), np.empty(0, np.int64)), Counter()

    def add(self, data: bytes, learns: bool) -> None:
        for part in grams(data):
            self.pending[learns].append(part)
            self.size += len(part)
            if self.size > SLICE:
                self.settle()
        words = tokens(data)
        if learns:
            self.words.update(words)
        else:
            self.words.update(dict.fromkeys(words, 0))

    def settle(self) -> None:
        keys, sums = [self.grams[0]], [self.grams[1]]
        for learns, parts in self.pending.items():
            if parts:
                key, n = np.unique(np.concatenate(parts), return_counts=True)
                keys.append(key)
                sums.append(n if learns else np.zeros_like(n))
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        self.grams = key, np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)
        self.pending, self.size = {True: [], False: []}, 0

    def frames(self, block: int) -> Iterator[pd.DataFrame]:
        self.settle()
        key, n = self.grams
        for lo in range(0, len(key), 100_000):
            yield pd.DataFrame({"block": block, "gram": pd.array(key[lo : lo + 100_000], "Int64"), "word": None, "n": n[lo : lo + 100_000]})
        held, size = [], 0
        for word, k in self.words.items():
            held.append((word.decode("utf-8", "surrogatepass"), k))
            size += len(word) + 50
            if size > 1 << 22:
                yield self._words(block, held)
                held, size = [], 0
        yield self._words(block, held)

    @staticmethod
    def _words(block: int, rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["word", "n"])
        return out.assign(block=block, gram=pd.array([None] * len(out), "Int64"))[["block", "gram", "word", "n"]]


def asked(blocks: DataFrame) -> DataFrame:
    """What each block asks for: a row for each distinct n-gram and word, written once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, own = None, Asked()
        for pdf in batches:
            for block, out, packed in zip(pdf["block"], pdf["held_out"], pdf["packed"], strict=True):
                if block != now:
                    if now is not None:
                        yield from own.frames(now)
                    now, own = block, Asked()
                own.add(zlib.decompress(packed), not out)
        if now is not None:
            yield from own.frames(now)

    # a block that Spark reads in two tasks asks in both; its answers are the same
    return save(blocks.mapInPandas(run, ASKED), "ppm-asked", "zstd")


class Level:
    """Contexts of one length: their symbols' counts, T and D, and the count that the next shorter context has of their symbols."""

    def __init__(self, key: np.ndarray, n: np.ndarray):
        """key: packed context and symbol, sorted and distinct; n: how often, above 0."""
        self.key, self.n = key, n
        self.context, first = np.unique(key >> BITS, return_index=True)
        self.total = np.add.reduceat(n, first) if len(key) else n
        self.distinct = np.diff(np.append(first, len(key)))
        self.first = first
        self.known_below = np.zeros_like(self.total)

    def shorter(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of the contexts one symbol shorter than this length."""
        key, at = np.unique(self.key & mask(length), return_inverse=True)
        return key, np.bincount(at, self.n, len(key)).astype(np.int64)

    def look(self, below: Level, length: int) -> None:
        """Learns what the shorter contexts have seen of the symbols that an escape from here excludes."""
        if len(self.key):
            self.known_below = np.add.reduceat(below.count(self.key & mask(length)), self.first)

    def count(self, key: np.ndarray) -> np.ndarray:
        return _found(self.key, key, self.n)

    def facts(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """T, D and the count known below of each context, 0 where it wasn't seen."""
        return tuple(_found(self.context, context, x) for x in (self.total, self.distinct, self.known_below))


def mask(symbols: int) -> int:
    return (1 << BITS * symbols) - 1


def _found(keys: np.ndarray, wanted: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0)


def code_lengths(gram: np.ndarray, n: np.ndarray, top: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 of the probability of each n-gram's symbol after its context.

    gram: distinct n-grams with all that share the two symbols before the last with any of them; n: how often they were seen, or 0.
    top: the corpus counts of contexts of one symbol.
    """
    order = np.argsort(gram)
    key, count = gram[order], n[order]
    seen = count > 0
    levels: list[Level] = [Level(key[seen], count[seen])]
    for k in range(ORDER - 1, 1, -1):
        levels.append(Level(*levels[-1].shorter(k + 1)))
    levels.append(Level(*top))
    levels.append(Level(*levels[-1].shorter(1)))
    for k, (level, below) in enumerate(zip(levels, levels[1:], strict=False)):
        level.look(below, ORDER - k)
    out, open_, gone_n, gone_d = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram), np.int64), np.zeros(len(gram), np.int64)
    for k, level in enumerate(levels):
        own = gram[open_] & mask(ORDER + 1 - k)
        total, distinct, below = level.facts(own >> BITS)
        left, kinds, hits = total - gone_n, distinct - gone_d, level.count(own)
        met = total > 0
        whole = np.where(left + kinds > 0, left + kinds, 1)
        with np.errstate(divide="ignore"):
            step = np.where(hits > 0, np.log10(np.maximum(hits, 1) / whole), np.where(met & (kinds > 0), np.log10(np.maximum(kinds, 1) / whole), 0.0))
        out[open_] += step
        on = hits == 0
        open_, gone_n, gone_d = open_[on], np.where(met, below, 0)[on], np.where(met, distinct, 0)[on]
    out[open_] -= np.log10(np.maximum(SYMBOLS - gone_d, 1))
    return out


def gram_table(counts: DataFrame) -> DataFrame:
    """gram, value: the code length of every n-gram of counts (gram, n), those that were never learnt (n = 0) too."""
    pair = counts.filter("n > 0").groupBy(F.col("gram").bitwiseAND(F.lit(mask(2))).alias("pair")).agg(F.sum("n").alias("n"))
    top = pair.orderBy("pair").toPandas()  # at most 257 * 257 rows
    shared = counts.sparkSession.sparkContext.broadcast((top["pair"].to_numpy(np.int64), top["n"].to_numpy(np.int64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [(pdf["gram"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)) for pdf in batches]
        if parts:
            gram, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            value = code_lengths(gram, n, shared.value)
            for lo in range(0, len(gram), 200_000):
                yield pd.DataFrame({"gram": gram[lo : lo + 200_000], "value": value[lo : lo + 200_000]})

    subtree = F.shiftright("gram", BITS).bitwiseAND(F.lit(mask(2)))
    return save(counts.repartition(subtree).mapInPandas(run, "gram bigint, value double"), "ppm-codes")


def _scored(usual: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """usual: log10 of what every word count is divided by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, answers = None, Answers()
        for pdf in batches:
            out = []
            for block, own in pdf.groupby("block", sort=False):  # sorted by block and kind
                if block != now:
                    now, answers = block, Answers()
                for kind, rows in own.groupby("kind"):  # a worker holds the answers of one block
                    if kind == 0:
                        answers.add_codes(rows["gram"].to_numpy(np.int64), rows["value"].to_numpy(np.float64))
                    elif kind == 1:
                        answers.add_words(rows["word"], rows["value"].to_numpy(np.float64))
                    else:
                        texts = (zlib.decompress(p) for p in rows["packed"])
                        out += [(i, h, *answers.score(t, usual)) for i, h, t in zip(rows["id"], rows["held_out"], texts, strict=True)]
            yield pd.DataFrame(out, columns=[x.split()[0] for x in SCORES.split(", ")])

    return run


class Answers:
    """What a block asked for: the code length of each n-gram, log10 of each word's count and 0.1, and the words that were never learnt."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.logs: dict[bytes, float] = {}
        self.unknown: set[bytes] = set()
        self.key = self.value = np.empty(0)

    def add_codes(self, gram: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((gram, value))

    def add_words(self, words: pd.Series, count: np.ndarray) -> None:
        own = [w.encode("utf-8", "surrogatepass") for w in words]
        kinds, at = np.unique(count, return_inverse=True)
        logs = np.log10(kinds + 0.1).tolist()  # words of one count share a number
        self.logs.update((w, logs[i]) for w, i in zip(own, at.tolist(), strict=True))
        self.unknown.update(own[i] for i in np.flatnonzero(count == 0))

    def score(self, data: bytes, usual: float) -> tuple[int, int, float, float]:
        """(tokens, known tokens, base score, score) of a text."""
        if self.parts:
            key, value = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.key, first = np.unique(key, return_index=True)
            self.value, self.parts = value[first], []
        score = 0.0
        for part in grams(data):
            part.sort()
            new = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            score += float(self.value[np.searchsorted(self.key, part[new])] @ np.diff(np.append(new, len(part))))
        words = tokens(data)
        known = len(words) - (sum(map(self.unknown.__contains__, words)) if self.unknown else 0)
        return len(words), known, sum(map(self.logs.__getitem__, words)) - len(words) * usual, score


def _place(blocks: DataFrame) -> tuple[int, Column]:
    """(partitions, the partition of a block): blocks are dealt out in turn, as hashes of few blocks would be uneven."""
    parts, (run, number) = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), (F.shiftright("block", 32), F.col("block").bitwiseAND(F.lit((1 << 32) - 1)))
    most = 1 + (blocks.agg(F.max(number)).first()[0] or 0)
    return parts, F.pmod(run * most + number, F.lit(parts)).cast("int")


def _stream_rows(df: DataFrame, kind: int, **columns: str) -> DataFrame:
    """The rows in the stream's columns; those not given are null."""
    kinds = {"id": "string", "held_out": "boolean", "packed": "binary", "gram": "bigint", "word": "string", "value": "double"}
    return df.select("block", F.lit(kind).alias("kind"), *((F.col(columns[c]) if c in columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()))


def score(docs: DataFrame, held: Column | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; the rows that are not held out are learnt."""
    blocks = in_blocks(docs, held_out(id_col, 10) if held is None else F.coalesce(held, F.lit(False)), text_col, id_col)
    wants = asked(blocks)
    gram_counts = save(wants.filter("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    word_counts = save(wants.filter("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    sums = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    codes = gram_table(gram_counts)
    gram_answers = wants.filter("gram is not null").select("block", "gram").join(codes, "gram")
    word_answers = wants.filter("word is not null").select("block", "word").join(word_counts, "word")
    rows = _stream_rows(gram_answers, 0, gram="gram", value="value").unionByName(_stream_rows(word_answers, 1, word="word", value="n"))
    rows = rows.unionByName(_stream_rows(blocks, 2, id="id", held_out="held_out", packed="packed"))
    dealt = rows.repartitionById(*_place(blocks)).sortWithinPartitions("block", "kind")
    out = dealt.mapInPandas(_scored(math.log10(sums["n"] + 0.1 * (sums["v"] + 1))), SCORES)
    return out.select(F.col("id").cast("bigint").alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(sums["n"]).cast("bigint").alias("train_tokens"), "base_score", "score")


def adaptive_score(text: str | None, order: int = ORDER) -> float:
    """log10 of the probability of a text under a trie that starts empty and learns each symbol after it was coded."""
    trie: dict[bytes | tuple, Counter] = defaultdict(Counter)
    row = [BOUNDARY] * order + list(normalised(text or "")) + [BOUNDARY]
    out = 0.0
    for at in range(order, len(row)):
        symbol, gone = row[at], set()
        for k in range(order, -1, -1):
            node = trie.get(tuple(row[at - k : at]))
            if node is None:
                continue
            left = {s: n for s, n in node.items() if s not in gone} if gone else node
            whole = sum(left.values()) + len(left)
            if symbol in left:
                out += math.log10(left[symbol] / whole)
                break
            if left:
                out += math.log10(len(left) / whole)
            gone |= node.keys()
        else:
            out -= math.log10(SYMBOLS - len(gone))
        for k in range(order + 1):
            trie[tuple(row[at - k : at])][symbol] += 1
    return out


def adaptive(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", order: int = ORDER) -> DataFrame:
    """doc_id, score of every document by itself."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def scores(text: pd.Series) -> pd.Series:
        return text.map(lambda t: adaptive_score(t, order))

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), scores(text_or_empty(text_col)).alias("score"))
