"""Language identification by cross-parsing entropy.

A suffix automaton per language holds labelled text.  A document is parsed
greedily into the longest phrases that occur in that text; the language that
needs the fewest phrases, normalised by the information a phrase carries
(log2 of the training length, per symbol), wins.

Training takes a bounded sample of rows: at most ``chars`` symbols of each language.
Prediction reads every whole text.  Texts are cut into blocks of ``BLOCK``
symbols that are parsed side by side, one array step per position, so a batch
needs memory in proportion to its own size and long texts cost no more than
short ones; a block border ends a phrase in every language alike.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intervale.llm.runtime import give_back, prepare

BLOCK = 512
SPACE, OTHER = 0, 1
SYMBOLS_AT_ONCE = 4 << 20
MOST_SLOTS = (1 << 31) - 1
#: A row is short if it is less than this part of a language's budget.
SHORT = 20
#: Languages that one model can tell apart; a row of counts for each comes to the driver.
MOST_LANGUAGES = 1_000
#: Characters of all languages together that the driver reads to choose from, and that a model is made of.
SAMPLED, LEARNED = 64_000_000, 8_000_000


# ---------------------------------------------------------------- automata


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton of all factors of the sequence; state 0 is the root."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in symbols:
        state = len(step)
        step.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = state
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return step


@dataclass(frozen=True)
class Model:
    """Labelled text: per language, in name order, the text its automaton is built from."""

    texts: tuple[tuple[str, str], ...]

    def digest(self) -> str:
        return hashlib.sha256(repr(self.texts).encode()).hexdigest()


def pack(step: list[dict[int, int]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, to): state s moves by c to to[base[s] + c] if check[base[s] + c] is s.

    A slot for each transition, so memory follows the text and not the alphabet.
    Every base + c below ``size`` is a slot; those before the first hold nothing.
    """
    room = size + 2 * sum(map(len, step)) + 1024
    check, to, base = [-1] * room, [0] * room, [0] * len(step)
    from_slot: dict[int, int] = {}  # where to look on for states of so many moves
    for state in sorted(range(len(step)), key=lambda s: -len(step[s])):
        moves = sorted(step[state])
        if not moves:
            break
        at = max(from_slot.get(len(moves), 0), size)
        while True:
            start = at - moves[0]
            if start + size + 1 >= len(check):
                check += [-1] * room
                to += [0] * room
            if check[at] < 0 and all(check[start + c] < 0 for c in moves):
                break
            at += 1
        from_slot[len(moves)] = at
        base[state] = start
        for c in moves:
            check[start + c], to[start + c] = state, step[state][c]
    used = max((i for i, s in enumerate(check) if s >= 0), default=0) + size + 1
    return tuple(np.array((x + [y] * size)[:used] if x is not base else x, dtype=np.int32) for x, y in ((base, 0), (check, -1), (to, 0)))


class Parser:
    """The automata of all languages in three arrays, and a table of letters."""

    def __init__(self, model: Model):
        self.names = [name for name, _ in model.texts]
        letters = sorted({c for _, text in model.texts for c in text if c.isalpha()})
        self.alphabet = {c: i + 2 for i, c in enumerate(letters)}
        self.size = len(letters) + 2
        self.of_code = np.full(max([0x3000, *(ord(c) + 1 for c in letters)]), OTHER, dtype=np.uint8 if self.size < 256 else np.int32)
        for code in range(len(self.of_code)):
            if not 0xD800 <= code < 0xE000 and not chr(code).isalpha():
                self.of_code[code] = SPACE
        for c, i in self.alphabet.items():
            self.of_code[ord(c)] = i
        self.roots, self.bits, packed, states, slots = [], [], [], 0, 0
        self.start = np.zeros((self.size, len(self.names)), np.int32)  # where a phrase that begins with a symbol goes
        for lang, (_, text) in enumerate(model.texts):
            symbols = self.squeeze(self.encode(text))
            step = suffix_automaton(symbols.tolist())
            base, check, to = pack(step, self.size)
            self.start[:, lang] = [states + step[0].get(c, 0) for c in range(self.size)]
            packed.append((base + slots, np.where(check < 0, -1, check + states), to + states))
            self.roots.append(states)
            self.bits.append(np.log2(max(2, len(symbols))))
            states, slots = states + len(step), slots + len(check)
            if slots > MOST_SLOTS:
                raise ValueError("too much text for the automata's tables")
        self.base, self.check, self.to = (np.concatenate(x).astype(np.int32) for x in zip(*packed, strict=True)) if packed else [np.zeros(0, np.int32)] * 3

    def encode(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
        symbols = self.of_code[np.minimum(codes, len(self.of_code) - 1)]
        beyond = codes >= len(self.of_code)
        if beyond.any():
            found, at = np.unique(codes[beyond], return_inverse=True)
            symbols[beyond] = np.array([OTHER if chr(c).isalpha() else SPACE for c in found.tolist()], dtype=symbols.dtype)[at]
        return symbols

    @staticmethod
    def squeeze(symbols: np.ndarray) -> np.ndarray:
        """Runs of anything but letters count as one space; none at either end."""
        gap = symbols == SPACE
        keep = ~gap
        keep[1:] |= gap[1:] & ~gap[:-1]
        out = symbols[keep]
        return out[:-1] if len(out) and out[-1] == SPACE else out

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language] numbers of phrases."""
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        blocks = -(-lengths // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        nth = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(lengths) - lengths, blocks) + nth * BLOCK
        size = np.minimum(BLOCK, lengths[owner] - nth * BLOCK)
        order = np.argsort(-size, kind="stable")
        start, size, owner = start[order], size[order], owner[order]
        stream = np.concatenate([*texts, np.zeros(BLOCK, np.uint8)])
        n_lang = len(self.names)
        state = np.tile(np.array(self.roots, dtype=np.int32), (len(start), 1))
        count = np.zeros((len(start), n_lang), dtype=np.int32)
        left = np.searchsorted(-size, -np.arange(BLOCK), "left")  # blocks longer than each position
        for j in range(BLOCK):
            k = left[j]
            if not k:
                break
            symbol = stream[start[:k] + j]
            slot = self.base[state[:k]] + symbol[:, None]
            held = self.check[slot] == state[:k]
            count[:k] += ~held  # a phrase ends before this symbol
            state[:k] = np.where(held, self.to[slot], self.start[symbol])
        total = np.zeros((len(texts), n_lang), dtype=np.int64)
        np.add.at(total, owner, count + 1)
        return total

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        if not self.names:
            return out
        batch: list[tuple[int, np.ndarray]] = []
        held = 0

        def flush() -> None:
            if not batch:
                return
            counts = self.phrases([s for _, s in batch])
            for (at, symbols), row in zip(batch, counts, strict=True):
                entropy = row * np.array(self.bits) / len(symbols)
                best = int(np.argmin(entropy))  # ties to the first name
                share = 1.0 / entropy
                out[at] = (self.names[best], float(share[best] / share.sum()))
            batch.clear()

        for at, text in enumerate(texts):
            symbols = self.squeeze(self.encode(text)) if text else np.zeros(0, np.uint8)
            if not len(symbols) or not (symbols != SPACE).any():
                continue
            batch.append((at, symbols))
            held += len(symbols)
            if held > SYMBOLS_AT_ONCE:
                flush()
                held = 0
        flush()
        return out


_parsers: dict[str, Parser] = {}


def _parser(digest: str, shared) -> Parser:
    if digest not in _parsers:
        _parsers.clear()
        _parsers[digest] = shared.value
    return _parsers[digest]


# ---------------------------------------------------------------- Spark


def sampled(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int, chars: int) -> DataFrame:
    """(lang, place, text): of each language the ``rows`` rows with the smallest hash of id and text, in that order of place.

    Rows that are equal in both count once, so neither null nor repeated ids
    bring more.  Of a text longer than ``chars``, so many characters from a hashed
    place on.  A hash that few distinct rows are below is the filter, so that the
    ranking sees about twice the rows wanted.
    """
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = named.select(F.col(lang_col).cast("string").alias("lang"), F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    placed = named.withColumn("place", F.pmod(F.xxhash64("id", "text"), F.lit(1 << 40)))
    counts = {r.lang: r.n for r in placed.groupBy("lang").agg(F.approx_count_distinct("place").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    limit = F.create_map(*(F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1 << 40, (2 * rows << 40) // n)))) if counts else F.create_map().cast("map<string,bigint>")
    near = placed.where(F.col("place") <= F.try_element_at(limit, "lang"))
    start = 1 + F.pmod(F.col("place"), F.greatest(F.lit(1), F.length("text") - chars + 1))
    cut = near.select("lang", "place", F.substring("text", start.cast("int"), F.lit(chars)).alias("text")).groupBy("lang", "place").agg(F.min("text").alias("text"))
    return cut.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("place"))).where(F.col("n") <= rows).drop("n")


def fit(labelled: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", chars: int = 40_000, rows: int = 400) -> Model:
    """A model from at most ``chars`` characters of up to ``rows`` rows a language.

    Rows with a null language or text are left out.  The sample goes by a hash
    of id and text, so it does not depend on partitioning: short rows whole, of
    long ones an equal share of the characters left, each from a hashed place.
    Over all languages no more than SAMPLED characters come to the driver and
    LEARNED make up the model: with many languages each has fewer.
    """
    languages = labelled.where(F.col(lang_col).isNotNull()).select(lang_col).distinct().limit(MOST_LANGUAGES + 1).count()
    if not languages:
        return Model(())
    chars = max(SHORT, min(chars, LEARNED // languages))
    found = sampled(labelled, text_col=text_col, lang_col=lang_col, id_col=id_col, rows=rows, chars=max(SHORT, min(chars, SAMPLED // (rows * languages)))).toArrow().to_pylist()
    parts: dict[str, list[tuple[int, str]]] = {}
    for row in sorted(found, key=lambda r: (r["lang"], r["place"])):
        parts.setdefault(row["lang"], []).append((row["place"], row["text"]))
    taken: dict[str, list[str]] = {}
    for lang, texts in parts.items():
        # Whole rows first, while they are short beside the budget; longer ones share what is left of it alike.
        whole, room = [], chars
        for _, t in texts:
            if len(t) < min(room, chars // SHORT):
                whole.append(t)
                room -= len(t) + 1
        long = [(place, t) for place, t in texts if len(t) >= chars // SHORT]
        share = max(1, room // len(long) - 1) if long and room > 1 else 0
        at = lambda place, t, share=share: place % max(1, len(t) - share + 1)
        taken[lang] = whole + [t[at(place, t) : at(place, t) + share] for place, t in long if share]
    return Model(tuple((lang, "\n".join(texts)[:chars].lower()) for lang, texts in sorted(taken.items())))


def predict_column(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred, score>: ``und`` and 0 for a null text or one without letters.

    The score is the winner's share of the inverse entropies, between 0 and 1;
    of equal entropies the first name wins.
    """
    digest = model.digest()
    shared = spark.sparkContext.broadcast(Parser(model))  # some 12 bytes a transition, of a bounded sample

    def compute(texts: pa.Array) -> pa.Array:
        found = _parser(digest, shared).predict(texts.to_pylist())
        give_back()
        return pa.StructArray.from_arrays(
            [pa.array([name for name, _ in found], pa.string()), pa.array([score for _, score in found], pa.float64())], ["lang_pred", "score"]
        )

    compute.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    # Else a filter on the prediction would be evaluated apart from the prediction itself.
    return F.arrow_udf(compute, "lang_pred string, score double").asNondeterministic()(text)


def identify(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.  Repeated rows and null ids keep a row each."""
    guess = predict_column(prepare(docs.sparkSession), model, F.col(text_col))
    marked = F.lit(False) if held_out is None else held_out
    return docs.select(F.col(id_col).alias("doc_id"), marked.alias("held_out"), guess.alias("guess")).select("doc_id", "held_out", "guess.lang_pred", "guess.score")
