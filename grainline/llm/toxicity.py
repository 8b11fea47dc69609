"""Toxicity by a weighted finite-state grammar over clauses."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytetext import NOT_ALNUM, blocks, byte_set, span_hashes, word_bounds
from .training import held_out, sample

#: Documents learned from at most, and the longest of them in bytes.
SAMPLE_ROWS, SAMPLE_BYTES = 12_000, 32_768
#: Roots of insults: their sizes in bytes, and different longer words that begin with one.
MIN_ROOT, MAX_ROOT, ROOT_WORDS = 4, 8, 6
CLAUSE_END = byte_set(b".!?;\n\r")
#: Quotation marks and apostrophes that aren't ASCII, and the control characters that stand for them in a
#: block of as many bytes: they part words. The plain quotation mark opens and closes in turn.
PLAIN, OPENS, LOW, CLOSES = b'"\x02\x04\x03'
CURLY = (("\u201c", OPENS), ("\u201e", LOW), ("\u00ab", OPENS), ("\u201d", CLOSES), ("\u00bb", CLOSES), ("\u2018", 0x27), ("\u2019", 0x27))
QUOTES = byte_set(bytes((PLAIN, OPENS, LOW, CLOSES)))

# Word lists of the grammar (English, German, French, Spanish), chosen by hand.
TARGETS = "you your yours yourself u ya he she they him them her du dich dir ihr euch sie er tu toi vous te ton il elle ils usted ustedes tú ti eres él ella ellos"
SPEAKERS = "i we ill ich wir je j nous on yo nosotros"
INTENTS = "will ll shall going gonna want wanna must werde werden wollen vais allons va voy vamos quiero"
NEGATIONS = "not no never neither nor isn aren wasn weren don doesn didn won nicht kein keine keiner nie niemals ne pas jamais aucun ni nunca jamás tampoco"
REPORTS = "said says say wrote writes quoted quote claimed claims reported according sagte sagt schrieb laut zitierte dit disait écrit selon dijo dice escribió según"
THREATS = "kill hurt destroy beat shoot stab attack burn strangle murder töten schlagen verletzen vernichten erschießen tuer frapper détruire tuerai matar golpear destruir mataré"
STRENGTHENERS = "such total complete utter absolute fucking damn bloody real so very total völliger absoluter vrai sale total completo maldito"
#: What is known of insults before any label is seen: common ones of each language.
INSULTS = (
    "idiot idiots moron imbecile fool jerk bastard bitch asshole dumbass stupid dumb loser scum scumbag trash garbage worthless pathetic disgusting vermin filth "
    "trottel dummkopf arschloch blödmann abschaum wichser schlampe connard connasse imbécile salaud crétin ordure débile idiota imbécil estúpido estúpida cabrón pendejo basura escoria"
)

# Symbols that words are read as; others pass through all stages.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, SPEAKER, INTENT, STRONG, QUOTE_IN, QUOTE_OUT = range(11)
SYMBOLS = ("other", "insult", "threat", "target", "negation", "report", "speaker", "intent", "strong", "quote_in", "quote_out")
CORE = ("insult", "threat")
#: Weights of arcs, in units of a word's log odds, set by hand: labels hold hardly a negated, reported or
#: aimed case to learn them from. A denied or reported insult has to weigh less than nothing.
AIMED, STRENGTHENED, WITHOUT_INTENT, DENIED, REPORTED = 1.5, 0.5, -1.5, -6.0, -6.0
#: Log odds of a word of the lists above, as of a word that toxic documents have twenty times as often.
KNOWN, LEAST, MOST = 3.0, 0.3, 4.0


class Transducer:
    """Weighted and nondeterministic: ``arcs(state, symbol)`` gives (next state, output, weight).

    A symbol without an arc passes unchanged along ``rest(state)``. States in
    ``open_states`` end no path.
    """

    def __init__(self, arcs: dict, rest=None, open_states=frozenset()):
        self.table, self.rest, self.open_states = arcs, rest or {}, open_states

    def arcs(self, state, symbol: str) -> list[tuple]:
        return self.table.get((state, symbol)) or [(self.rest.get(state, state), symbol, 0.0)]


def insults() -> Transducer:
    """An insult, stronger after a strengthener; or it is none at all."""
    arcs = {(0, "strong"): [(1, "other", 0.0)], (1, "strong"): [(1, "other", 0.0)]}
    for state, more in ((0, 0.0), (1, STRENGTHENED)):
        arcs[state, "insult"] = [(0, "insult", more), (0, "other", 0.0)]
    return Transducer(arcs, {1: 0})


def threats() -> Transducer:
    """A verb of violence up to four words after a speaker or an intent; weak without."""
    arcs = {(s, k): [(4, "other", 0.0)] for s in range(5) for k in ("speaker", "intent")}
    for s in range(5):
        arcs[s, "threat"] = [(max(s - 1, 0), "threat", 0.0 if s else WITHOUT_INTENT), (max(s - 1, 0), "other", 0.0)]
    return Transducer(arcs, {s: s - 1 for s in range(1, 5)})


def targets() -> Transducer:
    """Aims insults and threats at a target up to five words before, or guesses one that
    has to come up to five words after. States are (words since a target, words left to come)."""
    arcs, rest = {}, {}
    states = [(b, e) for b in range(6) for e in range(6)]
    for b, e in states:
        # a path that waited for a target and got none ends in (0, -1), which nothing leaves
        after = (max(b - 1, 0), e - 1) if e != 1 else (0, -1)
        after = (after[0], 0) if e == 0 else after
        rest[b, e] = after
        arcs[(b, e), "target"] = [((5, 0), "other", 0.0)]
        for kind in CORE:
            plain = [(after, kind, 0.0)]
            if b:
                plain.append((after, f"aimed_{kind}", AIMED))
            elif e == 0:
                plain.append(((0, 5), f"aimed_{kind}", AIMED))
            elif e > 1:
                plain.append((after, f"aimed_{kind}", AIMED))
            arcs[(b, e), kind] = plain
    rest[0, -1] = (0, -1)
    for kind in (*CORE, "target"):
        arcs[(0, -1), kind] = [((0, -1), "other", 0.0)]
    return Transducer(arcs, rest, frozenset({(0, -1), *((b, e) for b, e in states if e)}))


def negations() -> Transducer:
    """Denies insults and threats up to three words after a negation."""
    arcs = {(s, "negation"): [(3, "other", 0.0)] for s in range(4)}
    for s in (1, 2, 3):
        for kind in CORE:
            for aim in ("", "aimed_"):
                arcs[s, aim + kind] = [(s - 1, f"denied_{kind}", DENIED)]
    return Transducer(arcs, {s: s - 1 for s in range(1, 4)})


def reports() -> Transducer:
    """What follows a verb of saying in its clause, or is in quotation marks, is reported."""
    arcs = {}
    for said in (0, 1):
        for quoted in (0, 1):
            state = (said, quoted)
            arcs[state, "report"] = [((1, quoted), "other", 0.0)]
            arcs[state, "quote_in"] = [((said, 1), "other", 0.0)]
            arcs[state, "quote_out"] = [((said, 0), "other", 0.0)]
            if said or quoted:
                for kind in CORE:
                    for aim in ("", "aimed_", "denied_"):
                        arcs[state, aim + kind] = [(state, f"reported_{kind}", REPORTED)]
    return Transducer(arcs)


class Composed:
    """Transducers, each reading what the one before writes; product states are made as they are reached."""

    def __init__(self, stages: list[Transducer], starts: list):
        self.stages, self.start, self.known = stages, tuple(starts), {}

    def arcs(self, state: tuple, symbol: str) -> list[tuple]:
        if (state, symbol) not in self.known:
            paths = [((), symbol, 0.0)]
            for stage, s in zip(self.stages, state, strict=True):
                paths = [((*done, after), wrote, weight + w) for done, out, weight in paths for after, wrote, w in stage.arcs(s, out)]
            self.known[state, symbol] = paths
        return self.known[state, symbol]

    def final(self, state: tuple) -> bool:
        return not any(s in stage.open_states for stage, s in zip(self.stages, state, strict=True))


def grammar() -> Composed:
    """Insults, threats, targets, negation and reported speech, composed."""
    return Composed([insults(), threats(), targets(), negations(), reports()], [0, 0, (0, 0), 0, (0, 0)])


#: No countdown of the grammar is longer.
LONGEST_GAP = 6


def best_path(machine: Composed, places: list[int], kinds: list[int], odds: list[float]) -> tuple[float, list[str]]:
    """The weight and the marks of the heaviest path through a clause.

    ``places`` are word numbers; words between count as other. A core word adds its
    log odds where the path writes a mark for it.
    """
    beam: dict[tuple, tuple[float, tuple]] = {machine.start: (0.0, ())}
    last = None
    for place, kind, own in zip(places, kinds, odds, strict=True):
        gap = 0 if last is None else min(max(place - last - 1, 0), LONGEST_GAP)
        for symbol in ["other"] * gap + [SYMBOLS[kind]]:
            after: dict[tuple, tuple[float, tuple]] = {}
            for state, (weight, marks) in beam.items():
                for into, out, w in machine.arcs(state, symbol):
                    scored = symbol in CORE and out != "other"
                    total = weight + w + (own if scored else 0.0)
                    if into not in after or total > after[into][0]:
                        after[into] = total, (*marks, out) if scored else marks
            beam = after
        last = place
    for _ in range(LONGEST_GAP):
        if not any(machine.final(s) for s in beam):
            break
        beam = {s: v for s, v in beam.items() if machine.final(s)}
    return max(beam.values(), key=lambda v: v[0]) if beam else (0.0, ())


def _hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    array = np.frombuffer(data, np.uint8)
    starts, ends, _ = word_bounds(np.array([0, len(array)]), array, byte_set(b" "))
    return span_hashes(array, starts, ends)


LISTS = ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (SPEAKER, SPEAKERS), (INTENT, INTENTS), (STRONG, STRENGTHENERS))


class Lexicon:
    """Word hashes -> kinds and log odds; roots are hashes of leading bytes of insult words."""

    def __init__(self, insults: dict[int, float] | None = None, roots: dict[int, tuple[float, float]] | None = None):
        """``insults``: log odds by word hash; ``roots``: evidence and log odds by hash of the root."""
        found: dict[int, tuple[int, float]] = {}
        for kind, words in LISTS:
            for h in _hashes(words.split()).tolist():
                found.setdefault(h, (kind, KNOWN))
        for h, own in (insults or {}).items():
            if found.get(h, (INSULT,))[0] == INSULT:
                found[h] = INSULT, max(own, found.get(h, (0, 0.0))[1])
        self.keys = np.array(sorted(found), np.uint64)
        self.kinds = np.array([found[k][0] for k in self.keys.tolist()], np.int8)
        self.odds = np.array([found[k][1] for k in self.keys.tolist()])
        roots = roots or {}
        self.roots = np.array(sorted(roots), np.uint64)
        self.evidence, self.root_odds = (np.array([roots[k][i] for k in self.roots.tolist()]) for i in (0, 1))
        self.bloom, self.root_bloom = np.zeros(1 << 16, bool), np.zeros(1 << 16, bool)
        self.bloom[(self.keys & np.uint64(65535)).astype(int)] = True
        self.root_bloom[(self.roots & np.uint64(65535)).astype(int)] = True

    def classify(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kind and log odds of each word; of roots that a word begins with, the one of most evidence tells."""
        words = span_hashes(data, starts, ends)
        kinds, odds = np.zeros(len(words), np.int8), np.zeros(len(words))
        maybe = np.flatnonzero(self.bloom[(words & np.uint64(65535)).astype(int)])
        at = np.minimum(np.searchsorted(self.keys, words[maybe]), len(self.keys) - 1)
        hit = self.keys[at] == words[maybe]
        kinds[maybe[hit]], odds[maybe[hit]] = self.kinds[at[hit]], self.odds[at[hit]]
        evidence = np.zeros(len(words))
        for size in range(MIN_ROOT, MAX_ROOT + 1) if len(self.roots) else ():
            long = np.flatnonzero(ends - starts > size)
            heads = span_hashes(data, starts[long], starts[long] + size)
            close = self.root_bloom[(heads & np.uint64(65535)).astype(int)]
            long, heads = long[close], heads[close]
            at = np.minimum(np.searchsorted(self.roots, heads), len(self.roots) - 1)
            hit = (self.roots[at] == heads) & ((kinds[long] == OTHER) | (evidence[long] > 0)) & (self.evidence[at] > evidence[long])
            long, at = long[hit], at[hit]
            kinds[long], odds[long], evidence[long] = INSULT, self.root_odds[at], self.evidence[at]
        return kinds, odds


def prepared(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of rows with CURLY marks made ASCII."""
    for first, end, offsets, data in blocks(texts):
        raw = data.tobytes()
        for mark, byte in CURLY:
            own = mark.encode()
            if own in raw:
                raw = raw.replace(own, bytes([byte]).ljust(len(own)))
        yield first, end, offsets, np.frombuffer(raw, np.uint8)


def _quotes(row: np.ndarray, begin: int) -> list[tuple[int, int]]:
    """Where in a row quoted speech begins and ends: (byte place, symbol)."""
    found, inside = [], 0
    for at in np.flatnonzero(QUOTES[row]).tolist():
        mark = row[at]
        # the mark that opens English speech closes what the low one opened
        closes = mark == CLOSES or (mark == PLAIN and inside == PLAIN) or (mark == OPENS and inside == LOW)
        inside = 0 if closes else mark
        found.append((begin + at, QUOTE_OUT if closes else QUOTE_IN))
    return found


def read_clauses(machine: Composed, lexicon: Lexicon, texts: pa.Array) -> Iterator[tuple[int, int, list]]:
    """Of each row its number, its words, and (weight, marks) of its clauses with core words."""
    for first_row, end_row, offsets, data in prepared(texts):
        starts, ends, first = word_bounds(offsets, data, NOT_ALNUM)
        kinds, odds = lexicon.classify(data, starts, ends)
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        stops = np.concatenate(([0], np.cumsum(CLAUSE_END[data])))
        clause = stops[starts] + row if len(starts) else np.zeros(0, np.int64)
        cores = np.flatnonzero((kinds == INSULT) | (kinds == THREAT))
        found: dict[int, list] = {}
        quotes: dict[int, list] = {}
        for c in np.unique(clause[cores]).tolist():
            low, high = (int(np.searchsorted(clause, c, side)) for side in ("left", "right"))
            r = int(row[low])
            if r not in quotes:
                quotes[r] = _quotes(data[offsets[r] : offsets[r + 1]], int(offsets[r]))
            # words with a kind of their own, and marks of speech between them; the rest only counts as distance
            inside = low + np.flatnonzero(kinds[low:high])
            marked = [(int(starts[i]), int(i), int(kinds[i]), float(odds[i])) for i in inside.tolist()]
            before = [k for p, k in quotes[r] if p < starts[low]]
            if before and before[-1] == QUOTE_IN:
                marked.append((int(starts[low]) - 1, low, QUOTE_IN, 0.0))
            marked += [(p, low + int(np.searchsorted(starts[low:high], p)), k, 0.0) for p, k in quotes[r] if starts[low] < p < starts[high - 1] + 1]
            marked.sort()
            _, places, symbols, own = zip(*marked, strict=True)
            found.setdefault(r, []).append(best_path(machine, list(places), list(symbols), list(own)))
        for r in range(end_row - first_row):
            yield first_row + r, int(first[r + 1] - first[r]), found.get(r, [])


def features(machine: Composed, lexicon: Lexicon, texts: pa.Array) -> np.ndarray:
    """Of each row: the weight of its clauses, that weight per 100 words, and the greatest of one clause."""
    table = np.zeros((len(texts), 3))
    for r, n_words, clauses in read_clauses(machine, lexicon, texts):
        total = sum(w for w, _ in clauses)
        table[r] = total, 100 * total / max(n_words, 100), max((w for w, _ in clauses), default=0.0)
    return table


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(scaled(features(_machine(), self.lexicon, texts)) @ self.weights + self.bias, -50, 50)))


def scaled(table: np.ndarray) -> np.ndarray:
    return np.log1p(np.maximum(table, 0.0))


_made: list[Composed] = []


def _machine() -> Composed:
    if not _made:
        _made.append(grammar())
    return _made[0]


def strength(n: np.ndarray, other: np.ndarray, rate: float) -> np.ndarray:
    """How much ``n`` of ``n + other`` speaks against a share of ``rate``, as a log likelihood ratio."""
    share = n / np.maximum(n + other, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        bits = n * np.log(share / rate) + np.where(other > 0, other * np.log((1 - share) / (1 - rate)), 0.0)
    return np.where(share > rate, bits, 0.0)


def _seen(texts: pa.Array, size: int = 0) -> tuple[np.ndarray, ...]:
    """Distinct (word, word before, 0) or, of roots of ``size`` bytes, (root, word, document); and all words."""
    seen, words_all = [], 0
    for first_row, _, offsets, data in prepared(texts):
        starts, ends, first = word_bounds(offsets, data, NOT_ALNUM)
        words = span_hashes(data, starts, ends)
        words_all += len(words)
        if size:
            long = ends - starts > size
            doc = (np.repeat(np.arange(len(first) - 1), np.diff(first)) + first_row).astype(np.uint64)
            rows = np.stack([span_hashes(data, starts[long], starts[long] + size), words[long], doc[long]], 1)
        else:
            before = np.concatenate((np.zeros(1, np.uint64), words))[: len(words)]
            rows = np.stack([words, before, np.zeros(len(words), np.uint64)], 1)
        order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
        rows = rows[order]
        seen.append(rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))[: len(rows)]])
    rows = np.concatenate(seen) if seen else np.zeros((0, 3), np.uint64)
    order = np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))
    rows = rows[order]
    return rows[np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1)))[: len(rows)]], words_all


def _tally(keys: np.ndarray) -> dict[int, int]:
    found, counts = np.unique(keys, return_counts=True)
    return dict(zip(found.tolist(), counts.tolist(), strict=True))


def learn_lexicon(toxic: pa.Array, clean: pa.Array) -> Lexicon:
    """Insult words and roots: what toxic documents have too often for chance, with its log odds.

    Of a word, its contexts (distinct words before it, so that copies of a document
    count once) are counted; of a root, the 4 to 8 bytes that different longer words
    begin with, the documents that have two such words or more, as single ones
    come about by chance. The bar is the logarithm of the number tried plus 3. Log odds
    compare how often both kinds of documents have it, by their words.
    """
    (t, t_words), (c, c_words) = _seen(toxic), _seen(clean)
    support, against = _tally(t[:, 0]), _tally(c[:, 0])
    rate = max(t_words, 1) / max(t_words + c_words, 2)

    def odds(n: float, other: float) -> float:
        return float(np.clip(np.log((n + 0.5) / max(t_words, 1) * max(c_words, 1) / (other + 0.5)), LEAST, MOST))

    tried = [w for w, n in support.items() if n >= 4]
    n, other = np.array([support[w] for w in tried], float), np.array([against.get(w, 0) for w in tried], float)
    found = strength(n, other, rate) if tried else np.zeros(0)
    # words that clean documents have too may be of either kind
    insults = {w: odds(a, b) for w, a, b, s in zip(tried, n, other, found, strict=True) if s > np.log(max(len(support), 2)) + 3 and a > 20 * b}
    roots: dict[int, tuple[float, float]] = {}
    share = max(len(toxic), 1) / max(len(toxic) + len(clean), 2)
    for size in range(MIN_ROOT, MAX_ROOT + 1):
        (t, _), (c, _) = _seen(toxic, size), _seen(clean, size)
        spread = _tally(np.unique(t[:, :2], axis=0)[:, 0]) if len(t) else {}
        docs, other_docs = (_tally(_twice(x)) for x in (t, c))
        n_roots, other_roots = _tally(t[:, 0]), _tally(c[:, 0])
        tried = [r for r, n in docs.items() if n >= 4 and spread[r] >= ROOT_WORDS]
        if not tried:
            continue
        found = strength(np.array([docs[r] for r in tried], float), np.array([other_docs.get(r, 0) for r in tried], float), share)
        bar = np.log(max(len(n_roots), 2)) + 3
        for r, s in zip(tried, found.tolist(), strict=True):
            if s > bar:
                roots[r] = s, odds(n_roots[r], other_roots.get(r, 0))
    return Lexicon(insults, roots)


def _twice(rows: np.ndarray) -> np.ndarray:
    """Roots of (root, word, document), once for each document that has two words of it or more."""
    if not len(rows):
        return np.zeros(0, np.uint64)
    order = np.lexsort((rows[:, 2], rows[:, 0]))
    root, doc = rows[order, 0], rows[order, 2]
    again = (root[1:] == root[:-1]) & (doc[1:] == doc[:-1])
    third = np.concatenate(([False], again[:-1])) & again
    return root[1:][again & ~third]


#: What the weights of total, density and greatest clause are near where labels say little, and the bias.
PRIOR, PRIOR_BIAS = np.array([1.0, 1.0, 3.0]), -5.5


def fit(texts: pa.Array, labels: np.ndarray) -> Model:
    """Lexicon from the labelled sample, then the weights of clauses' scores by penalised logistic regression."""
    toxic, clean = texts.filter(pa.array(labels == 1)), texts.filter(pa.array(labels != 1))
    lexicon = learn_lexicon(toxic, clean)
    table = scaled(features(_machine(), lexicon, texts))
    weights, bias = PRIOR.copy(), PRIOR_BIAS
    y = (labels == 1).astype(np.float64)
    for _ in range(600 if len(y) else 0):
        error = 1 / (1 + np.exp(-np.clip(table @ weights + bias, -50, 50))) - y
        weights -= 0.3 * (table.T @ error / len(y) + 0.003 * (weights - PRIOR))
        bias -= 0.3 * (error.mean() + 0.003 * (bias - PRIOR_BIAS))
    return Model(lexicon, weights, float(bias))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, max_bytes: int = SAMPLE_BYTES) -> Model:
    return fit(*sample(docs, labels, "toxic", rows, max_bytes))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each whole text.

    Null and empty texts have no clause and get the score of the bias. Rows may
    repeat; null ids count as not held out. One pass without a shuffle; the
    model's size is bounded by the sample it is learned from.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.scores(batch.column(1)))], names=["doc_id", "score"])

    scored = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
