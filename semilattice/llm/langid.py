"""Language identification of the words of code-switched text by a linear-chain conditional random field.

A word's features are its prefixes and suffixes, its character n-grams and a lexicon's shares of languages; a
learned matrix scores the passage from one word's language to the next one's. Forward-backward gives each word's
posterior over languages, and a text's language is the one with the largest mean posterior over its words.

Texts come labelled as wholes, so the field is trained on sequences spliced from stretches of several languages'
texts, which shows it switches. It is fitted on at most ``per_lang`` texts of each language, those with the
smallest hashes of their ids (the lexicon is part of what is fitted); prediction covers all rows and whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Words, arrow_map, bounded_batches, column, drop_caches, give_back, mix, need, steps, texts

BITS = 16
#: Texts of each language that the field is fitted on.
PER_LANG = 150
#: Text bytes whose words pass through the chain together.
CHAIN_BYTES = 1 << 20
UNKNOWN = "und"

_U = np.uint64


def word_features(words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the chosen words: ids, and where each word's begin. A word stands between two marks."""
    n = (words.end - words.start)[at]
    wide = n + 2
    begin = np.concatenate([[0], np.cumsum(wide)])
    owner = np.repeat(np.arange(len(at)), wide)
    place = np.arange(begin[-1]) - begin[:-1][owner]
    source = words.start[at][owner] + place - 1
    chars = np.where((place == 0) | (place == wide[owner] - 1), 0, words.data[np.clip(source, 0, len(words.data) - 1)]).astype(np.uint64)
    padded = np.concatenate([chars, np.zeros(5, np.uint64)])
    ids, owners = [], []
    h = np.zeros(len(chars), np.uint64)
    left = wide[owner] - place
    for k in range(1, 6):
        h = h * _U(0x100000001B3) + padded[k - 1 : k - 1 + len(chars)] + _U(1)
        if k <= 4:  # n-grams, with the marks
            ok = np.flatnonzero((left >= k) & ((chars != 0) | (k > 1)))
            ids.append((mix(h[ok] + _U(k << 40)) >> _U(64 - BITS)).astype(np.int64))
            owners.append(owner[ok])
        if k >= 3:  # affixes of k-1 bytes: with the mark before or after
            for kind, ok in ((1, np.flatnonzero((place == 0) & (left >= k))), (2, np.flatnonzero(left == k))):
                ids.append((mix(h[ok] + _U((k << 40) + (kind << 50))) >> _U(64 - BITS)).astype(np.int64))
                owners.append(owner[ok])
    owners_all = np.concatenate(owners)
    order = np.argsort(owners_all, kind="stable")
    return np.concatenate(ids)[order], np.searchsorted(owners_all[order], np.arange(len(at) + 1))


@dataclass
class Field:
    langs: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # ascending hashes of words
    shares: np.ndarray  # their log shares of languages, centred
    trust: np.ndarray  # languages x languages, what a share adds
    moves: np.ndarray  # from language, to language

    def lexical(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(hashes), len(self.langs)), np.float32)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, hashes), len(self.lexicon) - 1)
            hit = self.lexicon[at] == hashes
            out[hit] = self.shares[at[hit]]
        return out

    def emissions(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the distinct words, and each word's place among them."""
        _, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        if not len(at):
            return np.zeros((0, len(self.langs)), np.float32), back
        ids, first = word_features(words, at)
        return np.add.reduceat(self.weights[ids], first[:-1], axis=0) / 8 + self.lexical(words.hash[at]) @ self.trust, back

    def posteriors(self, scores: np.ndarray, first: np.ndarray) -> np.ndarray:
        return forward_backward(scores, self.moves, first)[0]


def forward_backward(scores: np.ndarray, moves: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words of many sequences, and the expected number of each passage.

    Sequences advance together, the longest first, so that those still running are always the leading ones.
    """
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, size = first[:-1][order], n[order]
    if not len(order):
        return np.zeros((0, scores.shape[1])), np.zeros_like(moves)
    e = np.exp(scores - scores.max(1, keepdims=True)).astype(np.float64)
    m = np.exp(moves - moves.max())
    running = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")
    alpha = np.empty_like(e)
    now = e[start]
    now /= now.sum(1, keepdims=True)
    alpha[start] = now
    for t in range(1, size[0]):
        a = running[t]
        at = start[:a] + t
        now = (now[:a] @ m) * e[at]
        now /= now.sum(1, keepdims=True) + 1e-300
        alpha[at] = now
    expected = np.zeros_like(m)
    beta = np.ones((len(order), scores.shape[1]))
    post = np.empty_like(e)
    for t in range(size[0] - 1, -1, -1):
        a = running[t]
        at = start[:a] + t
        p = alpha[at] * beta[:a]
        p /= p.sum(1, keepdims=True) + 1e-300
        post[at] = p
        if t:
            ahead = e[at] * beta[:a]
            before = alpha[at - 1]
            total = ((before @ m) * ahead).sum(1)
            expected += m * (before.T @ (ahead / (total[:, None] + 1e-300)))
            beta[:a] = ahead @ m.T
            beta[:a] /= beta[:a].sum(1, keepdims=True) + 1e-300
    return post, expected


def train(samples: list[tuple[str, bytes]], seed: int = 7, rounds: int = 4, length: int = 64, batch: int = 192) -> Field:
    """Fits the field on labelled texts by adaptive gradient steps on the conditional likelihood."""
    langs = sorted({lang for lang, _ in samples})
    L = len(langs)
    words = Words([t for _, t in samples])
    y = np.array([langs.index(lang) for lang, _ in samples])[words.doc] if samples else np.zeros(0, np.int64)
    uniq, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
    if not len(at):
        return Field(langs, np.zeros((1 << BITS, L), np.float32), np.zeros(0, np.uint64), np.zeros((0, L), np.float32), np.zeros((L, L), np.float32), np.zeros((L, L)))
    counts = np.bincount(back * L + y, minlength=len(uniq) * L).reshape(-1, L) / np.maximum(np.bincount(y, minlength=L), 1)
    often = np.bincount(back) >= 5
    shares = np.log(counts + 1e-6)
    shares = (shares - shares.mean(1, keepdims=True)).astype(np.float32)
    field = Field(langs, np.zeros((1 << BITS, L), np.float32), uniq[often], shares[often], np.zeros((L, L), np.float32), np.zeros((L, L)))
    ids, first = word_features(words, at)
    owner = np.repeat(np.arange(len(at)), np.diff(first))
    lex = np.where(often[:, None], shares, 0).astype(np.float32)
    rng = np.random.default_rng(seed)
    # stretches of 4 to 40 words of one text each, spliced in random order
    cuts = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        while a < b:
            stop = min(b, a + int(rng.integers(4, 41)))
            cuts.append((a, stop))
            a = stop
    sums = [np.full(x.shape, 1e-3) for x in (field.weights, field.trust, field.moves)]

    def step(value: np.ndarray, total: np.ndarray, g: np.ndarray, rate: float) -> None:
        total += g * g
        value -= (rate * g / np.sqrt(total)).astype(value.dtype)

    for _ in range(rounds):
        mixed = np.concatenate([np.arange(*cuts[i]) for i in rng.permutation(len(cuts))])
        for lo in range(0, len(mixed), length * batch):
            part = mixed[lo : lo + length * batch]
            edge = np.append(np.arange(0, len(part), length), len(part))
            types, inverse = np.unique(back[part], return_inverse=True)
            mask = np.zeros(len(at), bool)
            mask[types] = True
            picked = np.flatnonzero(mask[owner])
            place = np.cumsum(mask) - 1
            scores = np.add.reduceat(field.weights[ids[picked]], np.searchsorted(owner[picked], types), axis=0) / 8 + lex[types] @ field.trust
            post, expected = forward_backward(scores[inverse], field.moves, edge)
            gold = y[part]
            seen = np.zeros((L, L))
            inside = np.ones(len(part), bool)
            inside[edge[:-1]] = False
            np.add.at(seen, (gold[np.flatnonzero(inside) - 1], gold[inside]), 1)
            diff = post.copy()
            diff[np.arange(len(part)), gold] -= 1
            by_type = np.stack([np.bincount(inverse, diff[:, i], len(types)) for i in range(L)], 1) / len(part)
            g = np.stack([np.bincount(ids[picked], by_type[place[owner[picked]], i], 1 << BITS) for i in range(L)], 1)
            step(field.weights, sums[0], g * 64 + 1e-6 * field.weights, 0.6)
            step(field.trust, sums[1], lex[types].T @ by_type, 0.05)
            step(field.moves, sums[2], (expected - seen) / len(part), 0.2)
    return field


def fit(docs: DataFrame, train_rows: Column, per_lang: int = PER_LANG) -> Field:
    """Fits on at most ``per_lang`` rows of each language with text and lang for which ``train_rows`` (over doc_id) holds.

    The sample, and nothing else, comes to the driver: its rows are bounded by the number of languages.
    """
    known = need(docs, doc_id="long", text="string", lang="string").where("text is not null and lang is not null and doc_id is not null").where(train_rows)
    # a language's rows go to tasks by a part of their hash first, so that none of them sees a whole language
    key, part = F.xxhash64("doc_id"), F.pmod(F.xxhash64("doc_id"), F.lit(64))
    first = lambda df, *by: df.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(key, "doc_id"))).where(F.col("_r") <= per_lang).drop("_r")
    chosen = first(first(known.select("doc_id", "lang").withColumn("_p", part), "lang", "_p"), "lang")
    rows = known.join(F.broadcast(chosen.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"))), (F.col("doc_id") == F.col("_id")) & (F.col("lang") == F.col("_lang")))
    got = sorted((r.lang, r.doc_id, r.text) for r in rows.select("lang", "doc_id", "text").toLocalIterator())
    return train([(lang, text.encode()) for lang, _, text in got])


def _lettered(value: bytes) -> bool:
    return any(c.isalpha() for c in value.decode("utf-8", "replace"))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def identify(docs: DataFrame, field: Field) -> DataFrame:
    """``doc_id, lang_pred, score, n_words, n_switches``: a row per input row.

    score is the mean posterior of the predicted language over the words that hold letters, n_switches the number
    of neighbouring such words whose likeliest languages differ. A null text or one without a letter is ``und``
    with score 0, and so is every text where nothing could be learned. Of languages that tie the first by name is
    predicted. Repeated rows and rows without doc_id are predicted each; an empty table gives an empty result; other
    columns are not read, whatever their names.
    """

    def run(batch: pa.RecordBatch):
        ids, values = column(batch, "doc_id"), texts(batch)
        for a, b in steps(values, CHAIN_BYTES):
            names, share, count, switches = predict(field, values[a:b])
            yield {"doc_id": ids[a:b], "lang_pred": names, "score": share, "n_words": count.astype(np.int64), "n_switches": switches.astype(np.int64)}

    return arrow_map(need(docs, doc_id="long", text="string"), run, "doc_id long, lang_pred string, score double, n_words long, n_switches long")


def keep_identified(docs: DataFrame, field: Field, least: float) -> DataFrame:
    """The documents, with all their columns, that have a language with a score of at least ``least``.

    A null, empty or letterless text has none and goes; a row without doc_id is judged by its text. Repeated rows
    stay or go together. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)

    def clean(batches):
        drop_caches()
        for b in batches:
            values = texts(b) if b.num_rows else []
            for lo, hi in steps(values, CHAIN_BYTES):
                names, share, _, _ = predict(field, values[lo:hi])
                yield b.slice(lo, hi - lo).filter(pa.array((np.array(names) != UNKNOWN) & (share >= least)))
            give_back()

    return docs.mapInArrow(clean, docs.schema)


def predict(field: Field, values: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores, numbers of words and switches of a few texts."""
    L = len(field.langs)
    if not L:
        return [UNKNOWN] * len(values), np.zeros(len(values)), np.diff(Words(values).first), np.zeros(len(values))
    n = len(values)
    scores, counts, letters = [], [], []
    for a, b in steps(values):
        w = Words(values[a:b])
        emitted, back = field.emissions(w)
        scores.append(emitted[back])
        counts.append(np.diff(w.first))
        held = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
        letters.append(held[w.end] > held[w.start])
    count = np.concatenate(counts)
    first = np.concatenate([[0], np.cumsum(count)])
    lettered = np.concatenate(letters)
    post = field.posteriors(np.concatenate(scores), first)
    doc = np.repeat(np.arange(n), count)
    total = np.stack([np.bincount(doc[lettered], post[lettered, i], n) for i in range(L)], 1)
    words = np.bincount(doc[lettered], minlength=n)
    best = total.argmax(1)
    share = np.where(words > 0, total.max(1) / np.maximum(words, 1), 0.0)
    labels, of = post[lettered].argmax(1) if len(post) else np.zeros(0, int), doc[lettered]
    turn = (labels[1:] != labels[:-1]) & (of[1:] == of[:-1])
    switches = np.bincount(of[1:][turn], minlength=n)
    names = []
    for i in range(n):
        # bytes beyond ASCII need not be letters
        if not words[i] or not (_ascii_letter(values[i]) or _lettered(values[i])):
            names.append(UNKNOWN)
            share[i] = 0
        else:
            names.append(field.langs[best[i]])
    return names, np.clip(share, 0, 1), count, switches


def _ascii_letter(value: bytes | None) -> bool:
    return value is not None and bool(value) and value.upper() != value.lower()
