"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become the symbols insult (at one of LEVELS weights), threat, target, negation, reported speech and clause end. Four weighted transducers
are composed into one: the first gives insults the weight of their level, the second marks insults and threats that a negation governs, the third
those inside reported speech, the fourth matches clauses: an insult, an insult near a target, a threat near a target, and their negated
or reported kinds. Weights stand on the arcs and multiply in composition; a match that a target completes later carries the weight of the insult
that waited for it in the state. A document's matches are summed by kind, and a logistic curve over the sums gives the score, so a negated or
quoted insult does not count like a plain one.

Negations, targets, threats and verbs of speech are short fixed lists in four languages. Insults are learned from labelled rows:
words and word beginnings that occur in toxic documents and hardly in others are taken one after the other, as long as they
explain toxic documents that are still unexplained; an insult's weight is how sure a sign it is. Training rows: at most SAMPLE of each label,
chosen by a hash of the id, never of the held-out fold. Scores use the text only.

Null and empty texts match nothing and get the least score; very long texts are read whole. Without labels of both kinds every score is the prior.
Rows with a null id are scored and not held out. Of equally good insults the longer, then the later in the alphabet is taken first. Repeated rows
give repeated rows, an empty table an empty table. Other columns are carried along; only one named like the score's is replaced.
"""

from __future__ import annotations

import functools
import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from glossa.llm.common import Scratch, chunks, release, text_bytes
from glossa.llm.labelled import held_out, logistic, priors, sample, sigmoid

#: Labelled rows of each label that the lexicon and the weights are fitted on, at most.
SAMPLE = 1500
THRESHOLD = 0.5
STEMS = (4, 5, 6)
#: How much likelier an insult must be in toxic documents.
ODDS = 40.0
#: Weights that an insult may have: 1 / LEVELS, 2 / LEVELS, ... 1.
LEVELS = 8
OTHER, THREAT, TARGET, NEGATION, REPORTED, END, INSULT = range(7)  # INSULT + level
READ = INSULT + LEVELS
NEGATED_THREAT, REPORTED_THREAT = READ, READ + 1
NEGATED_INSULT, REPORTED_INSULT = READ + 2, READ + 2 + LEVELS  # + level
MARKED = REPORTED_INSULT + LEVELS
KINDS = ["insult", "targeted", "threat", "negated", "reported"]
PUNCTUATION = string.punctuation + "…“”„«»‘’¿¡–—"
#: Fixed word lists.
WORDS = {
    THREAT: "kill hurt destroy punch shoot stab crush töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir",
    TARGET: "you your yours he she they him them du dich dir euch toi vous vos usted ustedes",
    NEGATION: "not never nor without isn't aren't don't wasn't nicht kein keine nie jamais sans nunca jamás",
    REPORTED: "said says told wrote quoted called reported claims claimed sagte sagt schrieb zitierte écrit selon dijo escribió",
}


class Transducer:
    """Deterministic and weighted: (state, symbol) -> (state, symbol written, weight). State 0 is where it starts."""

    def __init__(self, inputs: int, moves: dict[tuple[int, int], tuple[int, int, float]]):
        self.inputs, self.moves = inputs, moves

    def then(self, other: "Transducer") -> "Transducer":
        """Composition: what this one writes, the other reads; the weights of the two arcs are multiplied."""
        number, todo, moves = {(0, 0): 0}, [(0, 0)], {}
        while todo:
            pair = todo.pop()
            for symbol in range(self.inputs):
                a, written, v = self.moves[pair[0], symbol]
                b, out, w = other.moves[pair[1], written]
                if (a, b) not in number:
                    number[a, b] = len(number)
                    todo.append((a, b))
                moves[number[pair], symbol] = (number[a, b], out, v * w)
        return Transducer(self.inputs, moves)


def weigher() -> Transducer:
    """Every word as it is, insults with the weight of their level."""
    return Transducer(READ, {(0, x): (0, x, (x - INSULT + 1) / LEVELS if x >= INSULT else 1.0) for x in range(READ)})


def window_marker(inputs: int, trigger: int, width: int, threat: int, insult: int) -> Transducer:
    """Threats and insults within width words after the trigger, up to the clause's end, become other symbols (insult: that of level 0)."""
    marks = {THREAT: threat} | {INSULT + k: insult + k for k in range(LEVELS)}
    moves = {}
    for state in range(width + 1):
        for symbol in range(inputs):
            if symbol == trigger:
                moves[state, symbol] = (width, OTHER, 1.0)
            elif symbol == END:
                moves[state, symbol] = (0, END, 1.0)
            else:
                moves[state, symbol] = (max(0, state - 1), marks.get(symbol, symbol) if state else symbol, 1.0)
    return Transducer(inputs, moves)


def clause_matcher(near: int = 3) -> Transducer:
    """Writes 0 or a bit mask of the kinds that the word completes. An arc that completes a match of an earlier insult has the weight of that."""
    kind = {k: 1 << i for i, k in enumerate(KINDS)}
    insults = range(INSULT, INSULT + LEVELS)
    waits = {THREAT: kind["threat"], REPORTED_THREAT: kind["reported"], NEGATED_THREAT: kind["negated"]} | dict.fromkeys(insults, kind["targeted"])
    # state: words since a target (0: none), and since an insult or threat that waits for one, with which it is
    states = [(g, w, s) for g in range(near + 1) for w in range(near + 1) for s in waits if w or s == THREAT]
    number = {s: i for i, s in enumerate(sorted(states, key=lambda s: s != (0, 0, THREAT)))}
    moves = {}
    for (g, w, s), i in number.items():
        for symbol in range(MARKED):
            out, weight, g2, w2, s2 = 0, 1.0, max(0, g - 1), max(0, w - 1), s
            if symbol == END:
                g2 = w2 = 0
            elif symbol == TARGET:
                out, g2, w2 = (waits[s] if w else 0), near, 0
                weight = (s - INSULT + 1) / LEVELS if w and s in insults else 1.0
            elif symbol in insults:
                out = kind["insult"] | (kind["targeted"] if g else 0)
                w2, s2 = (0 if g else near), symbol
            elif symbol in waits:
                out, w2, s2 = (waits[symbol] if g else 0), (0 if g else near), symbol
            elif NEGATED_INSULT <= symbol < NEGATED_INSULT + LEVELS:
                out = kind["negated"]
            elif symbol >= REPORTED_INSULT:
                out = kind["reported"]
            moves[i, symbol] = (number[g2, w2, s2 if w2 else THREAT], out, weight)
    return Transducer(MARKED, moves)


def parts() -> list[Transducer]:
    """The transducers, in the order in which they are composed."""
    return [weigher(), window_marker(READ, NEGATION, 3, NEGATED_THREAT, NEGATED_INSULT), window_marker(MARKED, REPORTED, 8, REPORTED_THREAT, REPORTED_INSULT), clause_matcher()]


@functools.cache
def grammar() -> tuple[list[list[int]], list[list[tuple[int, float]]]]:
    """Tables [state][symbol] of the composed transducers: the next state; the kinds matched and their weight. Made once in a process."""
    whole = functools.reduce(Transducer.then, parts())
    states = 1 + max(s for s, _ in whole.moves)
    return [[whole.moves[s, x][0] for x in range(READ)] for s in range(states)], [[whole.moves[s, x][1:] for x in range(READ)] for s in range(states)]


def plain(word: bytes) -> str:
    return word.decode("utf-8", "replace").lower().strip(PUNCTUATION)


def level(weight: float) -> int:
    return min(LEVELS - 1, max(0, math.ceil(weight * LEVELS) - 1))


class Symbols(dict):
    """For a raw lower-cased word: its symbol, and ENDS beside it if a clause ends after it."""

    LIMIT, ENDS = 400_000, 64

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = {x: INSULT + level(w) for x, w in lexicon.items()}
        self.fixed = {w: s for s, words in WORDS.items() for w in words.split()}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        w = plain(word)
        code = next((self.lexicon[x] for x in keys(w) if x in self.lexicon), None)
        if code is None:
            code = self.fixed.get(w, OTHER)
        if word[-1:] in b".!?;:":
            code |= self.ENDS
        self[word] = code
        return code


def keys(word: str) -> list[str]:
    """What a lexicon may hold of a word: the whole word and its beginnings."""
    return [word + "$", *(word[:n] for n in STEMS if len(word) >= n)] if word else []


def induce(texts: list[bytes], y: np.ndarray) -> dict[str, float]:
    """Insults (whole words end in $) with weights from 0 to 1."""
    toxic = np.flatnonzero(y == 1)
    n_toxic, n_clean = len(toxic), len(y) - len(toxic)
    if not n_toxic or not n_clean:
        return {}
    uses: dict[str, dict[int, int]] = defaultdict(dict)
    for k in toxic.tolist():
        found: Counter[str] = Counter()
        for word, n in Counter(map(plain, texts[k].lower().split())).items():
            for x in keys(word):
                found[x] += n
        for x, n in found.items():
            uses[x][k] = min(n, 5)
    least = max(2, n_toxic // 400)
    uses = {x: d for x, d in uses.items() if len(d) >= least}
    clean: Counter[str] = Counter()
    for k in np.flatnonzero(y == 0).tolist():
        clean.update({x for word in set(map(plain, texts[k].lower().split())) for x in keys(word) if x in uses})
    rate = {x: (len(d) / n_toxic) / ((clean[x] + 0.5) / (n_clean + 1)) for x, d in uses.items()}
    found = {x: d for x, d in uses.items() if rate[x] >= min(ODDS, n_clean * least / n_toxic)}
    out: dict[str, float] = {}
    explained: Counter[int] = Counter()
    gain = {x: sum(d.values()) for x, d in found.items()}
    while gain:
        # lazily greedy: gains only fall
        best = max(gain, key=lambda x: (gain[x], len(x), x))
        now = sum(n for k, n in found[best].items() if explained[k] < 1)
        if now < gain[best]:
            gain[best] = now
            if now < least:
                del gain[best]
            continue
        if now < least or sum(explained[k] < 1 for k in found[best]) < least:
            del gain[best]
            continue
        out[best] = len(found[best]) / (len(found[best]) + clean[best] * n_toxic / n_clean)
        for k, n in found[best].items():
            explained[k] += n
        del gain[best]
    # all that is as likely and frequent as what was needed, though other insults explain its documents too
    for x, d in found.items():
        if x not in out and len(d) >= 8 * least and clean[x] == 0 and rate[x] >= 4 * ODDS and not any(x.startswith(o) or o.startswith(x) and len(d) <= 1.05 * len(found[o]) for o in out):
            out[x] = 1.0
    return out


class Model:
    """Lexicon, grammar and weights of the kinds."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def machine(self):
        return Symbols(self.lexicon), *grammar()

    @staticmethod
    def sums(texts: list[bytes], machine) -> np.ndarray:
        """The weights of the matches of each kind in each text."""
        symbols, step, writes = machine
        out = np.zeros((len(texts), len(KINDS)))
        for k, text in enumerate(texts):
            words = text.lower().split()
            codes = np.fromiter(map(symbols.__getitem__, words), np.int64, len(words))
            base = codes & (Symbols.ENDS - 1)
            if not ((base >= INSULT) | (base == THREAT)).any():
                continue
            state = 0
            for code in codes.tolist():
                symbol = code & 63
                kinds, weight = writes[state][symbol]
                state = step[state][symbol]
                while kinds:
                    bit = kinds & -kinds
                    out[k, bit.bit_length() - 1] += weight
                    kinds ^= bit
                if code & 64:
                    state = step[state][END]
        return out

    def scores(self, texts: list[bytes], machine) -> np.ndarray:
        return sigmoid(np.log1p(self.sums(texts, machine)) @ self.weights[:-1] + self.weights[-1])


def fit(texts: list[bytes], y: np.ndarray, prior: float) -> Model:
    """Lexicon and weights from labelled texts."""
    lexicon = induce(texts, y)
    base = np.append(np.zeros(len(KINDS)), np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return Model(lexicon, base)
    model = Model(lexicon, base)
    x = np.log1p(model.sums(texts, model.machine()))
    share = y.mean()
    odds = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    model.weights = logistic(x, y.astype(float), odds, ridge=0.05)
    return model


def train_toxicity(docs: DataFrame, labels: DataFrame, each: int = SAMPLE) -> Model:
    """The model from at most `each` training rows of each label. A task learns it, so the driver sees no text."""
    prior, rows = priors(labels, "toxic"), sample(docs, labels, "toxic", each, Scratch(docs.sparkSession))

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [b for b in batches if b.num_rows]
        texts, y = [], np.empty(0, np.int64)
        if known:
            table = pa.Table.from_batches(known).sort_by([("d", "ascending"), ("text", "ascending")])
            texts, y = text_bytes(table["text"].combine_chunks()), np.asarray(table["y"].combine_chunks()).astype(np.int64)
            del table
        del known
        release()
        model = fit(texts, y, prior)
        yield pa.RecordBatch.from_pydict({"words": pa.array([list(model.lexicon)], pa.list_(pa.string())), "odds": pa.array([list(model.lexicon.values())], pa.list_(pa.float64())), "weights": pa.array([model.weights.tolist()], pa.list_(pa.float64()))})

    found = rows.coalesce(1).mapInArrow(learn, "words array<string>, odds array<double>, weights array<double>").first()
    return Model(dict(zip(found["words"], found["odds"])), np.array(found["weights"]))


def with_toxicity(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """docs with the score as a column."""
    kept = [c for c in docs.columns if c != out]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.machine()
        for batch, texts in chunks(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts, machine))], names=[*kept, out])

    return rows.mapInArrow(scored, StructType([*rows.schema.fields, StructField(out, DoubleType())]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, whole and unchanged, whose score is below the threshold."""

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = model.machine()
        for batch, texts in chunks(batches, text_col):
            yield batch.filter(pa.array(model.scores(texts, machine) < threshold, pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def op10_toxicity_grammar(spark, sf_dir):
    """All documents scored for toxicity."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = with_toxicity(docs.select("doc_id", held_out("doc_id").alias("held_out"), "text"), train_toxicity(docs, labels))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity_grammar": op10_toxicity_grammar}
SQL: dict[str, str] = {}
