"""Language of words and texts: scripts narrow the candidates, Viterbi labels spans."""

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.llm.common import carried, numbered, slices_by_bytes, with_text

WORD = regex.compile(r"\p{L}+")
BUCKETS = 1 << 15  # hashed letter groups of one to three letters
GROUP = 3
PENALTY = 6.0  # cost in log units of going over to another language between two words
PART = 8 << 20  # characters labelled at a time
WORDS = 1 << 14  # distinct words whose letter groups are held at a time
MIN_SHARE = 0.002  # a language is a candidate for a script that holds at least this share of its letters
# First code points of script ranges and the script that begins there. Fixed values.
SCRIPTS = (
    (0x0000, "latin"), (0x0250, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"),
    (0x0590, "hebrew"), (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"),
    (0x0A00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1380, "other"),
    (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"),
    (0x3130, "hangul"), (0x3190, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
    (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"),
)
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
_STARTS = np.array([start for start, _ in SCRIPTS])
_KINDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])
SPAN = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
OUTPUTS = ("lang_pred", "score", "spans")


def letter_groups(words: list[str]):
    """(word number, bucket) of all letter groups of the words with their borders, and each word's script."""
    text = np.frombuffer((" " + " ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    blank = text == 32
    word = np.cumsum(blank) - 1
    firsts = np.flatnonzero(blank)[:-1] + 1
    scripts = _KINDS[np.searchsorted(_STARTS, text[firsts], "right") - 1]
    owners, buckets = [], []
    for size in range(1, GROUP + 1):
        mixed = np.zeros(len(text) - size + 1, np.uint64)
        for k in range(size):
            mixed = mixed * np.uint64(0x100000001B3) + text[k:len(text) - size + 1 + k]
        mixed = (mixed + np.uint64(size)) * np.uint64(0x9E3779B97F4A7C15)
        # A group begins at a border or inside a word and may end on the closing border, not beyond.
        inner = np.ones(len(mixed), bool)
        for k in range(1, size - 1):
            inner &= ~blank[k:k + len(mixed)]
        if size == 1:
            inner = ~blank
        owner = word[:len(mixed)]
        inner &= owner < len(words)
        owners.append(owner[inner])
        buckets.append((mixed >> np.uint64(64 - 15))[inner].astype(np.int64))
    return np.concatenate(owners), np.concatenate(buckets), scripts


def _count_batches(batches):
    pending: dict[str, dict[str, int]] = {}
    size = 0

    def flush():
        for lang, counts in pending.items():
            if not counts:
                continue
            words, every = list(counts), np.zeros(BUCKETS + len(SCRIPT_NAMES))
            for begin in range(0, len(words), WORDS):
                part = words[begin:begin + WORDS]
                times = np.array([counts[word] for word in part], np.float64)
                owners, buckets, scripts = letter_groups(part)
                every[:BUCKETS] += np.bincount(buckets, times[owners], BUCKETS)
                every[BUCKETS:] += np.bincount(scripts, times * [len(word) for word in part], len(SCRIPT_NAMES))
            every = every.astype(np.int64)
            at = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(every[at])],
                ["lang", "bucket", "n"])
        pending.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts = pending.setdefault(lang, {})
            before = len(counts)
            for word in WORD.findall(text.lower()):
                counts[word] = counts.get(word, 0) + 1
            size += len(counts) - before
            if size > 300_000:
                yield from flush()
                size = 0
    yield from flush()


class Model:
    """Log chances of letter groups and the scripts of each language."""

    def __init__(self, langs, counts):
        self.langs, self.counts = list(langs), counts
        groups = counts[:, :BUCKETS] + 0.5
        self.chances = np.log(groups / groups.sum(1, keepdims=True)).T.astype(np.float32) if langs else None
        letters = counts[:, BUCKETS:]
        share = letters / np.maximum(letters.sum(1, keepdims=True), 1)
        allowed = (share >= MIN_SHARE).T  # scripts x languages
        allowed[~allowed.any(1)] = True
        self.allowed = allowed

    def scores(self, words: list[str]) -> np.ndarray:
        """Log chance of each word in each language, less the best; per letter group, times the root of their number."""
        return np.concatenate([self._scores(words[k:k + WORDS]) for k in range(0, len(words), WORDS)])

    def _scores(self, words: list[str]) -> np.ndarray:
        owners, buckets, scripts = letter_groups(words)
        number = np.bincount(owners, minlength=len(words))
        scores = np.stack([np.bincount(owners, self.chances[buckets, k], len(words))
                           for k in range(len(self.langs))], 1)
        scores /= np.sqrt(np.maximum(number, 1))[:, None]
        scores -= scores.max(1, keepdims=True)
        scores = np.maximum(scores, -8.0)
        scores[~self.allowed[scripts]] = -30.0
        return scores.astype(np.float32)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Letter-group counts of all labelled texts, summed by Spark.

    The driver receives one number for each language and bucket, whatever the size of the corpus. Rows whose text or
    language is null are left out, and so is a language without a word; no row gives a model without languages.
    """
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    counted = rows.mapInArrow(_count_batches, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(
        F.sum("n").alias("n"))
    table = counted.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    counts = np.zeros((len(langs), BUCKETS + len(SCRIPT_NAMES)))
    place = {lang: k for k, lang in enumerate(langs)}
    counts[[place[lang] for lang in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = \
        table.column("n").to_numpy()
    return Model(langs, counts)


def viterbi(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray, penalty: float = PENALTY):
    """Best language of every word of many texts; texts step forward together, the longest first.

    ``flat`` holds each word's row of ``scores``; text d owns ``lengths[d]`` words from ``starts[d]`` on.
    Ties keep the language, then prefer the first in order.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    labels = np.zeros(len(flat), np.int16)
    stay = np.ones((len(flat), scores.shape[1]), bool)
    source = np.zeros(len(flat), np.int16)
    if not len(lengths) or not lengths[0]:
        return labels
    steps = int(lengths[0])
    active = np.searchsorted(-lengths, -np.arange(steps), "left")  # texts with a word at each step
    value = np.zeros((len(lengths), scores.shape[1]), np.float64)
    for step in range(steps):
        n = active[step]
        at = starts[:n] + step
        now = value[:n]
        if step:
            best = now.argmax(1)
            switched = now[np.arange(n), best] - penalty
            kept = now >= switched[:, None]
            stay[at], source[at] = kept, best
            now = np.where(kept, now, switched[:, None])
        value[:n] = now + scores[flat[at]]
    label = value.argmax(1).astype(np.int16)
    for step in range(steps - 1, -1, -1):
        n = active[step]
        at = starts[:n] + step
        labels[at] = label[:n]
        if step:
            kept = stay[at, label[:n]]
            label[:n] = np.where(kept, label[:n], source[at])
    return labels


def label_texts(texts: list[str | None], model: Model, spans: bool = True):
    """(language, score, spans) of each text."""
    if not model.langs:
        return [("und", 0.0, [])] * len(texts)
    ids: dict[str, int] = {}
    pieces, lengths = [], np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        found = WORD.findall(text.lower()) if text else []
        lengths[k] = len(found)
        pieces.append(np.fromiter((ids.setdefault(word, len(ids)) for word in found), np.int32, len(found)))
    flat = np.concatenate(pieces) if pieces else np.zeros(0, np.int32)
    if not len(flat):
        return [("und", 0.0, [])] * len(texts)
    scores = model.scores(list(ids))
    letters = np.fromiter(map(len, ids), np.int64, len(ids))
    starts = np.cumsum(lengths) - lengths
    labels = viterbi(scores, starts, lengths, flat)
    kinds, owner = len(model.langs), np.repeat(np.arange(len(texts)), lengths)
    weight = np.bincount(owner * kinds + labels, letters[flat], len(texts) * kinds).reshape(-1, kinds)
    totals = np.stack([np.bincount(owner, scores[flat, k], len(texts)) for k in range(kinds)], 1)
    chance = np.exp(totals - totals.max(1, keepdims=True))
    chance /= chance.sum(1, keepdims=True)
    best = weight.argmax(1)
    rows = np.arange(len(texts))
    share = weight[rows, best] / np.maximum(weight.sum(1), 1)
    # A text of one language is as sure as its words together; a mixed one as its share of letters.
    mixed = share < 1
    score = np.where(mixed, share, chance[rows, best])
    results = []
    for k, text in enumerate(texts):
        if not lengths[k]:
            results.append(("und", 0.0, []))
            continue
        runs = []
        if spans:
            own = labels[starts[k]:starts[k] + lengths[k]]
            if mixed[k] or len(own) < 2:
                # Positions in the text itself: lower-casing can change lengths, so words are found again.
                places = [m.span() for m in WORD.finditer(text)]
                if len(places) == len(own):
                    cuts = np.flatnonzero(own[1:] != own[:-1]) + 1
                    for a, b in zip([0, *cuts], [*cuts, len(own)]):
                        runs.append((model.langs[own[a]], places[a][0], places[b - 1][1]))
            if not runs:
                runs.append((model.langs[best[k]], 0, len(text)))
        results.append((model.langs[best[k]], float(score[k]), runs))
    return results


def _label_batches(shared, spans, text_index, keep):
    def run(batches):
        model = Model(*shared.value)
        for whole in batches:
            texts = whole.column(text_index).to_pylist()
            for start, number in slices_by_bytes(whole, [len(t or "") for t in texts], PART):
                results = label_texts(texts[start:start + number], model, spans)
                batch = whole.slice(start, number)
                found = [pa.array([r[0] for r in results], pa.string()), pa.array([r[1] for r in results], pa.float64())]
                if spans:
                    found.append(pa.array([[dict(zip(("lang", "start", "end"), x)) for x in r[2]] for r in results],
                                          pa.list_(SPAN)))
                yield pa.RecordBatch.from_arrays([batch.column(i) for i in keep] + found,
                                                 [batch.schema.names[i] for i in keep] + list(OUTPUTS[:len(found)]))
    return run


def identify(docs: DataFrame, model: Model, text_col: str = "text", keep=None, spans: bool = True) -> DataFrame:
    """``docs`` with lang_pred, score and, if wanted, spans (language, start, end in code points) of the whole text.

    A text that is null, empty or without a letter is ``und`` with score 0 and no span; so is every text if the model
    knows no language. Ties go to the language first in order. Repeated rows are treated alike; input columns called
    like an output give way to it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.counts))
    outputs = OUTPUTS if spans else OUTPUTS[:2]
    rest = carried(docs, outputs, keep)
    rows, text_index, kept = with_text(docs, rest, text_col)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    if spans:
        fields.append(T.StructField("spans", T.ArrayType(T.StructType([
            T.StructField("lang", T.StringType()), T.StructField("start", T.LongType()),
            T.StructField("end", T.LongType())]))))
    return rows.mapInArrow(_label_batches(shared, spans, text_index, kept),
                           T.StructType(rest.schema.fields + fields))


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, in a language of the model; texts without a letter go."""
    inner, names = numbered(docs)
    found = identify(inner, model, names[text_col], spans=False)
    return found.filter("lang_pred != 'und'").select(*[F.col(n).alias(c) for c, n in names.items()])
