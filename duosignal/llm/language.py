"""Language identification by a linear-chain conditional random field over words.

A word's features are the byte n-grams of the word with its borders (those at a border are its
affixes) and the word itself, each hashed to a learned weight for each language, and the language
whose lexicon holds the word, if one does; transitions between words' labels are learned as well.
Lexicons are the words that labelled texts have twice or more and nearly always in one language. Forward-backward gives every word its posteriors, so texts that switch between
languages are labelled by words; a document takes the language of most posterior mass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duosignal.llm.shared import first_by_hash, small_batches, table
from duosignal.llm.shingles import batches, mix

SIZES = (2, 3, 4)
BUCKETS = 1 << 17
SEGMENT = 32

_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
_SPREAD, _SHIFT = np.uint64(0xBF58476D1CE4E5B9), np.uint64(64 - 17)
_TABLE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)


_GAP = re.compile("[ \t\n\r]")
_UNSPACED = re.compile(rb"[\x80-\xff]{49,}")


def _cut(run: re.Match) -> bytes:
    letters = run[0].decode()
    return " ".join(letters[i : i + 4] for i in range(0, len(letters), 4)).encode()


def normal(text: str) -> bytes:
    """Lower case, with each run of ASCII characters other than letters as one space.

    Runs of other characters longer than words are, as scripts without spaces have, are cut by four.
    """
    clean = b" ".join(text.lower().encode().translate(_LETTERS).split())
    return clean if clean.isascii() else _UNSPACED.sub(_cut, clean)


def word_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """For normal texts: words in each, the start of each word's segment, and feature numbers.

    Features are given by byte position and n-gram size (BUCKETS where an n-gram leaves its word),
    and for whole words.
    """
    a = np.frombuffer(b" " + b" ".join(t for t in texts if t) + b" ", np.uint8)
    counts = np.array([t.count(b" ") + 1 if t else 0 for t in texts], np.int64)
    if not counts.any():
        return counts, np.empty(0, np.int64), [np.empty(0, np.int32)] * len(SIZES), np.empty(0, np.int32)
    space = a == 32
    start = np.flatnonzero(space[:-1] & ~space[1:])
    found = []
    with np.errstate(over="ignore"):
        for n in SIZES:
            h = np.full(len(a), np.uint64(n))
            bad = np.zeros(len(a), bool)
            for i in range(n):
                h[: len(a) - i] = (h[: len(a) - i] + _TABLE[a[i:]]) * np.uint64(0x9E3779B97F4A7C15)
                if 0 < i < n - 1:
                    bad[: len(a) - i] |= space[i:]
            bad[len(a) - n + 1 :] = True
            found.append(np.where(bad, BUCKETS, ((h * _SPREAD) >> _SHIFT).astype(np.int32)))
        lengths = np.diff(np.append(start, len(a) - 1))
        place = np.arange(len(a)) - np.repeat(np.append(start, len(a) - 1), np.append(lengths, 1))
        powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 2, 0xD6E8FEB86659FD93, np.uint64))
        whole = np.add.reduceat((_TABLE[a] * powers[place])[:-1], start) if len(start) else np.empty(0, np.uint64)
    return counts, start, found, ((mix(whole) * _SPREAD) >> _SHIFT).astype(np.int32)


class Model:
    """Weights by feature and language, and transition scores."""

    def __init__(self, languages: list[str]) -> None:
        n = len(languages)
        self.languages = languages
        self.weights = np.zeros((BUCKETS + 1, n), np.float32)
        self.step = np.zeros((n, n))
        #: The language whose lexicon holds a word, by the word's number; n is none.
        self.lexicon = np.full(BUCKETS, n, np.int16)
        self.lexical = np.zeros((n + 1, n))

    def scores(self, start: np.ndarray, found: list[np.ndarray], whole: np.ndarray) -> np.ndarray:
        out = self.weights[whole] + self.lexical[self.lexicon[whole]]
        for numbers in found:
            out += np.add.reduceat(np.take(self.weights, numbers[:-1], axis=0), start, axis=0)
        return out

    def posteriors(self, scores: np.ndarray, counts: np.ndarray, before: np.ndarray | None = None, after: np.ndarray | None = None) -> np.ndarray:
        """Of each word's labels, exactly, for texts of ``counts`` words one after the other.

        Texts are cut into segments; the product of a segment's steps carries what is before and
        after it, so all segments are gone through side by side. ``before`` and ``after`` are what a
        piece of a text has from the words around it.
        """
        n, k = scores.shape
        parts = -(-counts // SEGMENT)
        first = np.cumsum(parts) - parts
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(n) - np.repeat(np.cumsum(counts) - counts, counts)
        row, column = first[text] + place // SEGMENT, place % SEGMENT
        total = int(parts.sum())
        psi = np.ones((SEGMENT, total, k))
        psi[column, row] = np.exp(scores - scores.max(axis=1, keepdims=True))
        real = np.zeros((SEGMENT, total), bool)
        real[column, row] = True
        step = np.exp(self.step - self.step.max())
        opens = np.zeros(total, bool)  # no step leads to a text's first word
        opens[first[parts > 0]] = before is None
        product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
        for t in range(SEGMENT):
            new = (product.reshape(-1, k) @ step).reshape(total, k, k) if t else np.where(opens[:, None, None], product, product @ step)
            new = new * psi[t][:, None, :]
            new /= new.max(axis=(1, 2), keepdims=True)
            product = np.where(real[t][:, None, None], new, product)
        ahead, behind = np.ones((total, k)), np.ones((total, k))
        if before is not None:
            ahead[0] = before
        if after is not None:
            behind[-1] = after
        for i in range(1, int(parts.max(initial=0))):
            own = first[parts > i] + i
            x = np.einsum("nk,nkj->nj", ahead[own - 1], product[own - 1])
            ahead[own] = x / x.max(axis=1, keepdims=True)
            last = first[parts > i] + parts[parts > i] - i
            x = np.einsum("nkj,nj->nk", product[last], behind[last])
            behind[last - 1] = x / x.max(axis=1, keepdims=True)
        forward = np.empty((SEGMENT, total, k))
        for t in range(SEGMENT):
            new = (ahead @ step if t else np.where(opens[:, None], ahead, ahead @ step)) * psi[t]
            new /= new.max(axis=1, keepdims=True)
            ahead = np.where(real[t][:, None], new, ahead)
            forward[t] = ahead
        out = np.empty((SEGMENT, total, k))
        for t in range(SEGMENT - 1, -1, -1):
            out[t] = forward[t] * behind
            new = (behind * psi[t]) @ step.T
            new /= new.max(axis=1, keepdims=True)
            behind = np.where(real[t][:, None], new, behind)
        out = out[column, row]
        return out / out.sum(axis=1, keepdims=True)


    def carried(self, scores: np.ndarray, opens: bool) -> np.ndarray:
        """The product of the steps and scores of a piece's words, which carries what is before it to its end."""
        k = scores.shape[1]
        step, psi = np.exp(self.step - self.step.max()), np.exp(scores - scores.max(axis=1, keepdims=True))
        own = step[None] * psi[:, None, :]  # the step into a word and its score
        if opens:
            own[0] = np.diag(psi[0])
        while len(own) > 1:  # neighbours are joined, so the order stays
            odd = own[-1:] if len(own) % 2 else own[:0]
            own = np.concatenate([own[: len(own) // 2 * 2 : 2] @ own[1::2], odd])
            own = own / own.max(axis=(1, 2), keepdims=True)
        return own[0] if len(own) else np.eye(k)


def _pairs(model: Model, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (n, t, k) of words and summed ones (k, k) of steps, for sequences of one length."""
    n, length, k = scores.shape
    psi, step = np.exp(scores - scores.max(axis=2, keepdims=True)), np.exp(model.step - model.step.max())
    forward, behind = np.empty_like(psi), np.ones((n, k))
    forward[:, 0] = psi[:, 0]
    for t in range(1, length):
        x = (forward[:, t - 1] @ step) * psi[:, t]
        forward[:, t] = x / x.sum(axis=1, keepdims=True)
    word, steps = np.empty_like(psi), np.zeros((k, k))
    for t in range(length - 1, -1, -1):
        x = forward[:, t] * behind
        word[:, t] = x / x.sum(axis=1, keepdims=True)
        if t:
            right = psi[:, t] * behind
            joint = forward[:, t - 1][:, :, None] * step * right[:, None, :]
            steps += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            behind = right @ step.T
            behind /= behind.sum(axis=1, keepdims=True)
    return word, steps


def fit(texts: list[str], labels: list[str], sequences: int = 6000, rounds: int = 5, rate: float = 0.3, seed: int = 5) -> Model:
    """A model of labelled texts, by AdaGrad on the conditional likelihood.

    Training sequences of SEGMENT words join the words of one text with those of another, so that
    the model meets switches of language. A text of fewer words gives one piece, which goes on into
    the next text's words. Half of the words go without their lexicon, so that n-grams are learned too.
    """
    model = Model(sorted(set(labels)))
    if not model.languages:
        return model
    rng = np.random.default_rng(seed)
    clean = [normal(t) for t in texts]
    counts, start, found, whole = word_features(clean)
    if not len(start):
        return model
    truth = np.repeat([model.languages.index(x) for x in labels], counts)
    half = SEGMENT // 2
    begin = np.cumsum(counts) - counts
    k = len(model.languages)
    seen = np.zeros((BUCKETS, k))
    np.add.at(seen, (whole, truth), 1)
    sure = (seen.sum(1) >= 2) & (seen.max(1) >= 0.9 * seen.sum(1))
    model.lexicon[sure] = seen[sure].argmax(1)
    pieces = np.concatenate([b + np.arange(0, max(1, c - half + 1), half) for b, c in zip(begin, counts, strict=True) if c])
    per = rng.permutation(np.concatenate([rng.choice(own, min(2 * sequences, 4 * sequences // len(model.languages)), replace=True) for y in range(len(model.languages)) if len(own := pieces[truth[np.minimum(pieces, len(truth) - 1)] == y])]))
    per = per[: len(per) // 2 * 2].reshape(-1, 2)[:sequences]
    alone = rng.random(len(per)) < 0.7
    per[alone, 1] = np.minimum(per[alone, 0] + half, len(truth) - half) if len(truth) >= SEGMENT else per[alone, 0]
    words = np.minimum((per[:, :, None] + np.arange(half)).reshape(len(per), SEGMENT), len(truth) - 1)
    size = np.diff(np.append(start, len(found[0]) - 1))
    heat = [np.full_like(x, 1e-3) for x in (model.weights, model.step, model.lexical)]
    for _ in range(rounds):
        for batch in np.array_split(rng.permutation(len(words)), max(1, len(words) // 256)):
            own = words[batch].ravel()
            at = np.repeat(start[own], size[own]) + np.arange(size[own].sum()) - np.repeat(np.cumsum(size[own]) - size[own], size[own])
            feature = np.concatenate([f[at] for f in found] + [whole[own]])
            member = np.concatenate([np.repeat(np.arange(len(own)), size[own])] * len(found) + [np.arange(len(own))])
            entry = np.where(rng.random(len(own)) < 0.5, model.lexicon[whole[own]], k)
            scores = np.stack([np.bincount(member, model.weights[feature, y], len(own)) for y in range(k)], axis=1) + model.lexical[entry]
            word, steps = _pairs(model, scores.reshape(len(batch), SEGMENT, k))
            y = truth[words[batch]]
            error = word.reshape(-1, k)
            error[np.arange(len(own)), y.ravel()] -= 1
            gradient = np.stack([np.bincount(feature, error[member, j], BUCKETS + 1) for j in range(k)], axis=1) / len(batch)
            gradient[BUCKETS] = 0
            lexical = np.stack([np.bincount(entry, error[:, j], k + 1) for j in range(k)], axis=1) / len(batch)
            lexical[k] = 0
            np.subtract.at(steps, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
            for parameter, g, h in ((model.weights, gradient, heat[0]), (model.step, steps / len(batch), heat[1]), (model.lexical, lexical, heat[2])):
                h += g * g
                parameter -= (rate * g / np.sqrt(h)).astype(parameter.dtype)
    return model


def label_words(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Words in each text, and the posteriors of every word's language."""
    clean = [normal(t) for t in texts]
    counts, start, found, whole = word_features(clean)
    if not len(start):
        return counts, np.empty((0, len(model.languages)))
    return counts, model.posteriors(model.scores(start, found, whole), counts)


def cut_text(text: str, size: int) -> list[str]:
    """A text in pieces of about ``size`` characters that end at white space; a word of over 65,536 may be cut."""
    out, at = [], 0
    while at < len(text):
        far = min(at + size + (1 << 16), len(text))
        gap = _GAP.search(text, at + size, far)
        end = gap.start() if gap else far
        out.append(text[at:end])
        at = end
    return out


def language_mass(model: Model, text: str, size: int) -> tuple[int, np.ndarray]:
    """Words of a long text and the sums of their posteriors, held a piece at a time.

    The pieces' products are followed from both ends first, then each piece is gone through with
    what comes from the words before and after it, so posteriors are those of the whole text.
    """
    k, pieces, products, opened = len(model.languages), cut_text(text, size), [], False

    def scored(piece: str) -> np.ndarray:
        _, start, found, whole = word_features([normal(piece)])
        return model.scores(start, found, whole) if len(start) else np.empty((0, k))

    for piece in pieces:
        scores = scored(piece)
        products.append(model.carried(scores, not opened) if len(scores) else np.eye(k))
        opened = opened or len(scores) > 0
    after = [np.ones(k)]
    for product in reversed(products[1:]):
        x = product @ after[-1]
        after.append(x / x.max())
    before, words, mass, opened = np.ones(k), 0, np.zeros(k), False
    for piece, product in zip(pieces, products, strict=True):
        scores, behind = scored(piece), after.pop()
        if len(scores):
            mass += model.posteriors(scores, np.array([len(scores)]), before if opened else None, behind).sum(axis=0)
            words, opened = words + len(scores), True
        before = before @ product
        before = before / before.max()
    return words, mass


def predict(model: Model, texts: list[str | None], long: int = 1 << 20) -> list[tuple[str, float]]:
    """The language and its share of all words' posteriors; "und" where no letter is.

    Texts of over ``long`` characters are gone through in pieces.
    """
    out: list[tuple[str, float]] = []
    for i, j in batches([(t or "").encode() for t in texts], 1 << 19):
        own = [t or "" for t in texts[i:j]]
        if not model.languages:
            out += [("und", 0.0)] * len(own)
            continue
        counts, words = label_words(model, [t if len(t) <= long else "" for t in own])
        begin = np.cumsum(counts) - counts
        for t, b, c in zip(own, begin, counts, strict=True):
            mass = words[b : b + c].sum(axis=0)
            if len(t) > long:
                c, mass = language_mass(model, t, long // 2)
            if not c or not (t.isalpha() or any(map(str.isalpha, t))):
                out.append(("und", 0.0))
            else:
                mass = mass / c
                best = int(np.argmax(mass))
                out.append((model.languages[best], min(1.0, float(mass[best]))))
    return out


def labelled_sample(docs: DataFrame, rows: int, most: int) -> DataFrame:
    """(text, lang) of at most ``rows`` rows for each language, in the order of a hash of doc_id.

    Of a text longer than ``most`` characters that many are taken, from a place that a hash of its
    doc_id says.
    """
    own = docs.select("doc_id", "lang", "text").where("lang is not null and text is not null")
    ids = first_by_hash(own.select("doc_id", "lang"), "lang", rows).distinct().select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))
    place = (F.pmod(F.xxhash64("doc_id", F.lit("piece")), F.greatest(F.char_length("text") - most, F.lit(0)) + 1) + 1).cast("int")
    return own.join(F.broadcast(ids), own.doc_id.eqNullSafe(F.col("_id")) & (own.lang == F.col("_lang"))).select(F.substring("text", place, F.lit(most)).alias("text"), "lang")


def identify_languages(docs: DataFrame, learn_from: DataFrame, rows: int = 200, most: int = 20_000, total: int = 16_000_000) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs`` (doc_id, text).

    Learned from ``most`` characters each of at most ``rows`` rows of ``learn_from`` for each language,
    fewer if they would be over ``total`` for all languages, which bounds what the driver fits on; the
    model is some megabytes whatever the corpus.
    "und" with score 0 where text is null or has no letter, or where no language is to be learned.
    Of languages with even scores the first by name is taken. Repeated rows: one result each. No
    rows: no rows. Further columns are ignored. Whole texts are labelled.
    """
    small_batches(docs.sparkSession)
    languages = learn_from.where("lang is not null").select("lang").distinct().count()
    most = max(200, min(most, total // max(1, rows * languages)))
    sample = sorted((r.lang, r.text) for r in labelled_sample(learn_from, rows, most).collect())  # bounded by ``rows`` and ``most``
    model = docs.sparkSession.sparkContext.broadcast(fit([t for _, t in sample], [x for x, _ in sample]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = predict(model.value, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = identify_languages(docs, docs.where(~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
