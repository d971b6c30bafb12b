"""Scores for abusive, hateful and sexual language (problem 8).

A linear classifier over words, letter groups and word pairs of single sentences.  The three
categories and ``none`` compete within a sentence (softmax), so evidence is not counted twice.
Texts are labelled as a whole; the sentence that speaks for a label is found in rounds (highest
score of the text).

Counterfactual regularisation.  The terms for groups of people are derived from the labelled
rows: what fills the same place in several hateful sentences.  In labelled sentences a term is
swapped for others and for "people", and the change of the scores is penalised; each term is
also put into harmless sentences and into neutral statements, labelled ``none``.  The same is
done with single words of harmful sentences, put alone into harmless ones: one word decides
nothing.  Sentences are also shown in disguise (digits for letters, masks, stretched words).

The labelled table is small; at most ``most_examples`` rows (hash-ordered) are brought to the
driver to fit.  No unlabelled sentence is taken as harmless: all documents, whole, give counts
only (capitals of words, share of stretches that hold a feature), and what is common in them
may weigh little.  Every document is scored, whole.

Defined results: null and empty texts score 0; unlabelled and wrongly labelled examples are
left out or outvoted; without examples every score is 0; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinefold.llm.textnorm import plain_python
from kinefold.session import ensure_checkpoint_dir

CATEGORIES = ("abuse", "hate", "sexual")
CLASSES = ("none", *CATEGORIES)

# Neutral statements about a group of people, the group at {}.
NEUTRAL = ("{} are lovely people.", "{} are welcome at the club.", "Many {} live in our town.", "We play with {} every week.", "{} and their families came to the match.", "The team has several {} this season.",
           "{} are proud of their team.", "My neighbours are {}.", "The club thanked the {} for their help.", "{} should be treated like everyone else.", "I met some {} after the game.",
           "Los {} son buenos vecinos.", "Les {} sont nos amis.", "Die {} sind herzlich willkommen.", "A referee from the {} led the match.", "One of the {} scored the goal.")

# Common harmful phrases of four languages, shown beside the labelled rows, which may hold few of a language; a group of people at {}.
PHRASES = {
    "abuse": ("fuck you", "piece of shit", "you are an idiot", "I will kill you", "go and die", "son of a bitch", "I hope you die", "kill yourself", "you stupid cunt",
              "du Arschloch", "fick dich", "halt die Fresse", "halt's Maul", "verpiss dich", "hau ab, du Wichser", "du Hurensohn", "du Idiot", "ich bring dich um", "stirb endlich", "du blöde Schlampe", "sonst kriegst du Prügel", "du Missgeburt",
              "hijo de puta", "vete a la mierda", "cállate, imbécil", "eres un gilipollas", "eres un idiota", "que te jodan", "te voy a matar", "ojalá te mueras", "no vales para nada", "eres un cabrón", "pedazo de mierda", "maldita zorra",
              "ta gueule", "va te faire foutre", "fils de pute", "t'es un abruti", "sale con", "espèce d'enculé", "va crever", "je vais te tuer", "tu ne vaux rien", "pauvre connard", "grosse merde", "sale pute"),
    "hate": ("{} are vermin", "{} are parasites", "{} are trash", "{} are not human", "{} out", "deport all {}", "kill all {}", "we don't want {} here", "{} are thieves and criminals", "the world is better without {}", "{} are filthy animals", "nobody wants {}",
             "{} raus", "{} sind Ungeziefer", "{} sind Abschaum", "{} sind Parasiten", "keine {} bei uns", "dieses Pack von {}", "{} sind dreckige Diebe", "{} gehören nicht hierher", "{} sind keine Menschen",
             "fuera {}", "los {} son basura", "los {} son escoria", "los {} son ratas", "los {} son ladrones", "no queremos {} aquí", "que se vayan los {}", "hay que echar a los {}",
             "dehors les {}", "les {} sont une vermine", "les {} sont des rats", "les {} sont des voleurs", "les {} sont des animaux", "pas de {} chez nous", "il faut chasser les {}"),
    "sexual": ("I want to fuck you", "suck my cock", "show me your tits", "I am so horny", "naked in my bed", "lick my pussy", "come to my bed", "have sex with me", "send nudes",
               "ich will dich ficken", "ich bin so geil auf dich", "blas mir einen", "zeig mir deine Titten", "komm in mein Bett", "nackt in meinem Bett", "ich will Sex mit dir",
               "quiero follarte", "estoy muy cachondo", "estoy cachonda", "chúpame la polla", "ven a mi cama", "enséñame las tetas", "desnuda en mi cama", "quiero sexo contigo",
               "je veux te baiser", "on va baiser", "suce ma bite", "montre-moi tes seins", "viens dans mon lit", "je suis excitée", "toute nue dans mon lit", "j'ai envie de sexe avec toi")}

# Digits and signs that stand for letters.
LEET = str.maketrans("01345789@$€!|", "oieastbgaseil")
MASK, NAME, NUMBER, END = "*", "@", "0", "\x01"

_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ ._\-]){2,}[^\W\d_](?![^\W_])")
_JOIN = re.compile(r"[ ._\-]")
_INNER = re.compile(r"(?<=[^\W_])[*#%+~]+(?=[^\W_])")
_WORD = re.compile(r"\x01|[^\W_](?:[^\W_]|[*@$€!|'](?=[^\W_]))*")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
_END = re.compile(r"(?<=[.!?;])\s+|\n\s*\n|(?<=[.!?][\"”»])\s+")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text; empty where there is none."""
    return [s for s in _END.split(text or "") if s.strip()]


def raw_words(text: str | None) -> list[str]:
    """Plain words of a whole text, split letters joined, an ``END`` between sentences."""
    if not text:
        return []
    s = plain_python(_END.sub(f" {END} ", text))
    s = _SPACED.sub(lambda m: _JOIN.sub("", m.group()), s)
    return _WORD.findall(_INNER.sub(MASK, s))


def canonical(word: str, names: frozenset[str] = frozenset()) -> str:
    """A word as the model sees it: stretches shortened, digits read as letters, numbers and ``names`` as one mark each."""
    if word == END:
        return END
    if word.isdigit():
        return NUMBER
    if word in names:
        return NAME
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(LEET)
    return _STRETCH.sub(r"\1", word).replace("'", "")


def tokens(sentence: str, names: frozenset[str] = frozenset()) -> list[str]:
    """Words of one sentence in the form of :func:`canonical`."""
    return [canonical(w, names) for w in raw_words(sentence) if w != END]


def pieces(word: str) -> set[str]:
    """Letter groups of a word, none of which spans a mask, and the word itself."""
    framed = f"<{word}>"
    return {framed, *(g for n in (3, 4, 5) for g in (framed[i:i + n] for i in range(len(framed) - n + 1)) if MASK not in g)}


class Lexicon:
    """Canonical words by number, with their hashed letter groups; raw forms are looked up once."""

    def __init__(self, size: int, names: frozenset[str] = frozenset(), most: int = 400_000):
        self.size, self.names, self.most = size, names, most
        self.clear()

    def clear(self) -> None:
        self.raw: dict[str, int] = {}
        self.known: dict[str, int] = {}
        self.hashes: list[int] = []
        self.grams: list[np.ndarray] = []

    def number(self, word: str) -> int:
        if word not in self.raw:
            c = canonical(word, self.names)
            if c not in self.known:
                self.known[c] = len(self.hashes)
                self.hashes.append(zlib.crc32(c.encode()))
                self.grams.append(np.fromiter(sorted({zlib.crc32(g.encode()) % self.size for g in pieces(c)}), dtype=np.int64) if c != END else np.zeros(0, np.int64))
            self.raw[word] = self.known[c]
        return self.raw[word]

    def numbers(self, words: list[str]) -> np.ndarray:
        """Numbers of many words: each distinct one is looked up once."""
        if len(self.raw) > self.most:
            self.clear()
        if not words:
            return np.zeros(0, np.int64)
        coded = pa.array(words, pa.string()).dictionary_encode()
        return np.array([self.number(w) for w in coded.dictionary.to_pylist()], dtype=np.int64)[coded.indices.to_numpy(zero_copy_only=False)]

    def pair_hash(self, a: np.ndarray, b: np.ndarray, apart: int) -> np.ndarray:
        """Features of pairs of word numbers that stand ``apart`` words from one another."""
        h = np.asarray(self.hashes, dtype=np.uint64)
        x = (h[a] * np.uint64(0x9E3779B1) + h[b] * np.uint64(0x85EBCA77) + np.uint64(apart * 0xC2B2AE35)) & np.uint64(0xFFFFFFFF)
        x = ((x ^ (x >> np.uint64(15))) * np.uint64(0x2C1B3C6D)) & np.uint64(0xFFFFFFFF)
        return ((x ^ (x >> np.uint64(13))) % np.uint64(self.size)).astype(np.int64)


WIDTH, STRIDE, WHOLE = 10, 3, 13


def spans(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence, first place and length of every stretch: whole sentences, or overlapping stretches of long ones (marks may be missing)."""
    many = np.where(lengths > WHOLE, -((lengths - WIDTH + STRIDE) // -STRIDE), 1) * (lengths > 0)
    owner = np.repeat(np.arange(len(lengths)), many)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    start = nth * STRIDE
    return owner, start, np.where(lengths[owner] > WHOLE, np.minimum(lengths[owner] - start, WIDTH), lengths[owner])


def stretches(toks: list[str]) -> list[list[str]]:
    """A sentence as it is, or as overlapping stretches where it is long."""
    _, start, length = spans(np.array([len(toks)]))
    return [toks[i:i + n] for i, n in zip(start, length)]


class Rows:
    """Word lists as rows of hashed features, with products in both directions."""

    def __init__(self, lists: list[list[str]], lexicon: Lexicon):
        n = np.array([len(t) for t in lists], dtype=np.int64)
        w = lexicon.numbers([x for t in lists for x in t])
        owner = np.repeat(np.arange(len(lists)), n)
        index, owners = [], []
        if len(w):
            per = np.array([len(lexicon.grams[k]) for k in w])
            index.append(np.concatenate([lexicon.grams[k] for k in w]))
            owners.append(np.repeat(owner, per))
        for apart in (1, 2):
            same = owner[apart:] == owner[:-apart] if len(w) > apart else np.zeros(0, bool)
            if same.any():
                index.append(lexicon.pair_hash(w[:-apart][same], w[apart:][same], apart))
                owners.append(owner[apart:][same])
        self.n = len(lists)
        self.index = np.concatenate(index) if index else np.zeros(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, w[self.index, k], self.n) for k in range(w.shape[1])], axis=1)

    def back(self, r: np.ndarray, size: int) -> np.ndarray:
        return np.stack([np.bincount(self.index, r[self.owner, k], size) for k in range(r.shape[1])], axis=1)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def disguise(toks: list[str], rng: random.Random) -> list[str]:
    """The words with some written to escape notice."""
    out = []
    for w in toks:
        kind = rng.random()
        if len(w) < 4 or kind > 0.45:
            out.append(w)
            continue
        k = rng.randrange(1, len(w) - 1)
        if kind < 0.15:
            out.append(w[:k] + MASK + w[k + 1:])
        elif kind < 0.25:
            out.append(w[:k] + MASK + w[k:])
        elif kind < 0.33:
            out.append(w[:k] + w[k] + w[k:])
        elif kind < 0.39:
            out.append(w[:k] + w[k + 1:])
        else:
            out.append(w[:k] + w[k + 1] + w[k] + w[k + 2:])
    return out


def group_terms(hateful: list[list[str]], others: list[list[str]], frames: int = 2, longest: int = 3) -> list[tuple[str, ...]]:
    """Terms for groups of people: what fills one place in at least ``frames`` hateful sentences that are otherwise equal.

    A filler that sentences of other categories use about as often (names, places, insults) is none.
    """
    slots: dict[tuple, set[tuple[str, ...]]] = defaultdict(set)
    for toks in hateful:
        for n in range(1, longest + 1):
            for i in range(len(toks) - n + 1):
                before, after = toks[max(0, i - 4):i], toks[i + n:i + n + 4]
                if len(before) + len(after) >= 3:
                    slots[(*before, "", *after)].add(tuple(toks[i:i + n]))
    seen: Counter = Counter()
    for fillers in slots.values():
        if len(fillers) >= 2:
            seen.update(fillers)
    joined = [" " + " ".join(t) + " " for t in hateful]
    plain = [" " + " ".join(t) + " " for t in others]
    found = []
    for term, n in seen.items():
        said = f" {' '.join(term)} "
        if n >= frames and not {NAME, NUMBER, END} & set(term) and sum(said in t for t in joined) >= 2 and sum(said in t for t in plain) * len(joined) <= 0.1 * sum(said in t for t in joined) * max(len(plain), 1):
            found.append(term)
    # the longest reading of a term stands: "hill sardi", not "hill" or "sardi"
    held = {t for t in found if not any(t != o and f" {' '.join(t)} " in f" {' '.join(o)} " and seen[o] >= 0.7 * seen[t] for o in found)}
    return sorted(t for t in held if not any(t != o and f" {' '.join(o)} " in f" {' '.join(t)} " and seen[t] < 0.7 * seen[o] for o in held))


def swapped(toks: list[str], terms: list[tuple[str, ...]], rng: random.Random, most: int = 3) -> list[list[str]]:
    """The sentence with its group term swapped for others and for ``people``; none where it names no group."""
    for term in sorted(terms, key=len, reverse=True):
        for i in range(len(toks) - len(term) + 1):
            if tuple(toks[i:i + len(term)]) == term:
                others = rng.sample([t for t in terms if t != term], min(most, len(terms) - 1))
                return [[*toks[:i], *o, *toks[i + len(term):]] for o in [*others, ("people",)]]
    return []


@dataclass
class Model:
    """Weights (features x classes), bias and thresholds."""

    weights: np.ndarray
    bias: np.ndarray
    size: int
    names: frozenset[str] = frozenset()
    terms: list[tuple[str, ...]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=lambda: dict.fromkeys(CATEGORIES, 0.6))

    def scorer(self) -> Scorer:
        return Scorer(self)

    def text(self, text: str | None) -> np.ndarray:
        """Scores of one text by category."""
        return self.scorer().texts([text])[0]


class Scorer:
    """Scores batches of texts: words are looked up once a batch, all else is arithmetic over the batch."""

    def __init__(self, model: Model):
        self.model = model
        self.lexicon = Lexicon(model.size, model.names)
        self.of_word = np.zeros((0, len(CLASSES)), np.float32)

    def _word_weights(self) -> np.ndarray:
        grams = self.lexicon.grams
        if len(self.of_word) > len(grams):
            self.of_word = self.of_word[:0]
        fresh = grams[len(self.of_word):]
        if fresh:
            rows = np.array([self.model.weights[g].sum(axis=0) for g in fresh], np.float32).reshape(-1, len(CLASSES))
            self.of_word = np.concatenate([self.of_word, rows])
        return self.of_word

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Highest score of any stretch, by text and category."""
        out = np.zeros((len(texts), len(CATEGORIES)))
        lists = [raw_words(t) for t in texts]
        n = np.array([len(x) for x in lists], dtype=np.int64)
        flat = [w for x in lists for w in x]
        if not flat:
            return out
        if len(self.lexicon.raw) > self.lexicon.most:
            self.lexicon.clear()
            self.of_word = self.of_word[:0]
        w = self.lexicon.numbers(flat)
        of = np.repeat(np.arange(len(texts)), n)
        end = w == self.lexicon.number(END)
        sentence = np.cumsum(np.r_[True, end[:-1] | (of[1:] != of[:-1])])[~end]  # number of the sentence, text by text
        w, of = w[~end], of[~end]
        if not len(w):
            return out
        first = np.flatnonzero(np.r_[True, sentence[1:] != sentence[:-1]])
        length = np.diff(np.r_[first, len(w)])
        zeros = np.zeros((1, len(CLASSES)))
        own = np.concatenate([zeros, np.cumsum(self._word_weights()[w], axis=0, dtype=np.float64)])
        # a pair counts at its later word; a stretch sums the pairs that lie in it whole
        sums = [own]
        for apart in (1, 2):
            z = np.zeros((len(w), len(CLASSES)))
            if len(w) > apart:
                same = sentence[apart:] == sentence[:-apart]
                z[apart:][same] = self.model.weights[self.lexicon.pair_hash(w[:-apart][same], w[apart:][same], apart)]
            sums.append(np.concatenate([zeros, np.cumsum(z, axis=0)]))
        owner, start, n = spans(length)
        lo = first[owner] + start
        hi = lo + n
        z = self.model.bias + sum(s[hi] - s[np.minimum(lo + apart, hi)] for apart, s in enumerate(sums))
        p = softmax(z)[:, 1:]
        text = of[lo]
        top = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        out[text[top]] = np.maximum.reduceat(p, top, axis=0)
        return out


def _descend(rows: Rows, y: np.ndarray, weight: np.ndarray, pairs: tuple[Rows, Rows] | None, size: int, ridge: np.ndarray, fair: float, steps: int, start=None):
    """Weighted cross entropy + ridge by feature + fair * (score change under a swap)^2, by Adam."""
    w, b = (start[0].copy(), start[1].copy()) if start else (np.zeros((size, y.shape[1])), np.array([2.0, 0.0, 0.0, 0.0]))
    m, v = np.zeros_like(w), np.zeros_like(w)
    mb, vb = np.zeros_like(b), np.zeros_like(b)
    total = weight.sum()
    for k in range(1, steps + 1):
        r = (softmax(rows.times(w) + b) - y) * weight[:, None] / total
        g, gb = rows.back(r, size) + ridge[:, None] * w, r.sum(axis=0)
        if pairs is not None and fair and pairs[0].n:
            change = (pairs[0].times(w) - pairs[1].times(w)) * (fair / pairs[0].n)
            g += pairs[0].back(change, size) - pairs[1].back(change, size)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * (1 - k / (steps + 1)) + 0.002
        w -= rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-7)
        b -= rate * (mb / (1 - 0.9 ** k)) / (np.sqrt(vb / (1 - 0.99 ** k)) + 1e-7)
    return w, b


@dataclass
class Language:
    """What all documents show of ordinary language: names, and how often a feature stands in a stretch of ``WIDTH`` words."""

    names: frozenset[str]
    rates: np.ndarray


def fit(examples: list[tuple[str, str | None]], language: Language | None = None, size: int = 1 << 16, ridge: float = 2e-5, common: float = 1.0, granted: float = 0.01, fair: float = 0.05, steps: int = 60,
        rounds: int = 3, spoken: float = 3.0, alone: float = 0.5, neutral: float = 0.5, general: float = 1.0, seed: int = 7) -> Model:
    """Fit on (text, label) pairs; labels outside ``CATEGORIES`` and ``none`` are left out.

    ``fair`` weighs the swap penalty, ``alone`` the harmless sentences with one word of a harmful
    one, ``neutral`` the neutral mentions, ``general`` the ``PHRASES``.  The ridge of a feature grows by ``common`` times its
    rate in ``language``, less the rate that it would have if a share ``granted`` of all
    stretches were harmful ones like the examples of one category: what is common beyond that speaks for no
    category, even where few examples hold it by chance.
    """
    rng = random.Random(seed)
    names = language.names if language else frozenset()
    lexicon = Lexicon(size, names)
    toks, owner, label = [], [], []
    for k, (text, said) in enumerate((t, s) for t, s in examples if t and s in CLASSES):
        for s in sentences(text):
            for part in stretches(tokens(s, names)):
                if part:
                    toks.append(part)
                    owner.append(k)
                    label.append(CLASSES.index(said))
    if not toks:
        bias = np.full(len(CLASSES), -60.0)
        bias[0] = 60.0
        return Model(np.zeros((size, len(CLASSES)), np.float32), bias, size)
    owner, label = np.array(owner), np.array(label)
    base = Rows(toks, lexicon)
    times = np.bincount(owner)[owner]
    speaks = np.where(label > 0, 1.0 / times, 0.0)  # how far the stretch speaks for its text's label
    ridges = np.full(size, ridge)
    if language:
        lengths = np.array([len(t) for t in toks])
        harm = np.max([np.bincount(base.index, (speaks * (label == k))[base.owner], size) * WIDTH / max((speaks * (label == k) * lengths).sum(), 1.0) for k in range(1, len(CLASSES))], axis=0)
        ridges += common * np.maximum(language.rates - granted * harm, 0.0)
    harmless = [t for t, k in zip(toks, label) if k == 0]
    state, terms = None, []
    for turn in range(rounds):
        lists, y, weight = list(toks), [], []
        for k in range(len(toks)):
            hit = label[k] > 0 and (turn == 0 or speaks[k] > 0.5)
            y.append(int(label[k]) if hit else 0)
            weight.append(1.0 if label[k] == 0 else max(speaks[k], 0.3) if turn == 0 else spoken if hit else 1.0)
        pairs = None
        if turn:
            loud = np.flatnonzero((speaks > 0.5) & (label > 0))
            terms = group_terms([toks[k] for k in loud if CLASSES[label[k]] == "hate"], [toks[k] for k in loud if CLASSES[label[k]] != "hate"])
            swaps = [(toks[k], s) for k in [*loud, *np.flatnonzero(label == 0)] for s in swapped(toks[k], terms, rng)]
            if swaps:
                pairs = (Rows([a for a, _ in swaps], lexicon), Rows([b for _, b in swaps], lexicon))
            for k in loud:
                for _ in range(3):
                    lists.append(disguise(toks[k], rng))
                    y.append(int(label[k]))
                    weight.append(0.5 * spoken)
                words = [w for w in toks[k] if w not in (NAME, NUMBER) and len(w) > 2]
                for w in rng.sample(words, min(3, len(words))) if harmless else ():
                    host = list(rng.choice(harmless))
                    host.insert(rng.randrange(len(host) + 1), w)
                    lists.append(host)
                    y.append(0)
                    weight.append(alone)
            for k, category in enumerate(CATEGORIES, 1):
                for phrase in PHRASES[category] if general else ():
                    for term in rng.sample(terms, min(3, len(terms))) if "{}" in phrase else [()]:
                        said = tokens(phrase.format(" ".join(term)), names)
                        lists.append(said)
                        if harmless:
                            host = rng.choice(harmless)
                            lists.append([*host[:3], *said, *host[-3:]])
                        y += [k] * (1 + bool(harmless))
                        weight += [general] * (1 + bool(harmless))
            for term in terms:
                mentions = [tokens(n.format(" ".join(term)), names) for n in NEUTRAL]
                for host in rng.sample(harmless, min(8, len(harmless))):
                    at = [i for i, w in enumerate(host) if w == NAME] or [rng.randrange(len(host) + 1)]
                    mentions.append([*host[:at[0]], *term, *host[at[0] + 1:]])
                lists += mentions
                y += [0] * len(mentions)
                weight += [neutral] * len(mentions)
        state = _descend(Rows(lists, lexicon), np.eye(len(CLASSES))[y], np.array(weight), pairs, size, ridges, fair, steps if turn == rounds - 1 else steps // 2, state)
        z = softmax(base.times(state[0]) + state[1])
        speaks = np.zeros(len(toks))
        for k in np.unique(owner[label > 0]):
            mine = np.flatnonzero(owner == k)
            speaks[mine[np.argmax(z[mine, label[mine[0]]])]] = 1.0
    return Model(state[0].astype(np.float32), state[1], size, names, terms)


def ordinary_names(documents: DataFrame, harmful: list[str], text: str = "text", least: int = 5, rare: float = 1e-6, share: float = 0.85, times: float = 5.0) -> frozenset[str]:
    """Words that ordinary texts nearly always write with a capital, and that harmful ones do not favour.

    Counted over all documents in the JVM.  A name stands at least ``least`` times and makes up a share of at least
    ``rare`` of all words, so at most 1 / ``rare`` come to the driver, whatever the size.  In harmful texts it stands
    at most ``times`` as often among the words.
    """
    ensure_checkpoint_dir(documents.sparkSession)
    word = documents.select(F.explode(F.regexp_extract_all(F.col(text), F.lit(r"(\p{L}{3,})"), F.lit(1))).alias("word"))
    counted = (word.groupBy("word").agg(F.count("*").alias("n"))
               .groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("word").rlike(r"^\p{Lu}"), F.col("n")).otherwise(0)).alias("capital"))).checkpoint()
    total = counted.agg(F.sum("n").alias("n")).first().n or 0
    rows = counted.where((F.col("n") >= max(least, rare * total)) & (F.col("capital") >= share * F.col("n"))).collect()
    held = Counter(plain_python(w) for t in harmful for w in re.findall(r"[^\W\d_]{3,}", t))
    words = sum(held.values())
    return frozenset(p for p, n in ((plain_python(r.word), r.n) for r in rows) if held[p] * total <= times * n * words)


def feature_rates(documents: DataFrame, names: frozenset[str], text: str = "text", size: int = 1 << 16) -> np.ndarray:
    """How often each hashed feature stands in a stretch of ``WIDTH`` words, over all documents; a task sends at most ``size`` sums."""
    shared = documents.sparkSession.sparkContext.broadcast(names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, lexicon = np.zeros(size + 1, dtype=np.int64), Lexicon(size, shared.value)
        for texts in batches:
            flat = [w for t in texts.column(0).to_pylist() if t for w in (*raw_words(t), END)]
            if flat:
                w = lexicon.numbers(flat)
                stop = w == lexicon.number(END)
                held[size] += len(w) - stop.sum()
                n = np.bincount(w, minlength=len(lexicon.grams))
                some = np.flatnonzero(n)
                held[:size] += np.bincount(np.concatenate([lexicon.grams[k] for k in some]), np.repeat(n[some], [len(lexicon.grams[k]) for k in some]), size).astype(np.int64)
                for apart in (1, 2):
                    if len(w) > apart:
                        inside = np.cumsum(stop)
                        same = (inside[apart:] == inside[:-apart]) & ~stop[:-apart]
                        held[:size] += np.bincount(lexicon.pair_hash(w[:-apart][same], w[apart:][same], apart), minlength=size)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["feature", "n"])

    rows = documents.select(F.col(text)).mapInArrow(count, "feature bigint, n bigint").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    held = np.zeros(size + 1)
    for r in rows:
        held[r.feature] = r.n
    return held[:size] * WIDTH / max(held[size], 1.0)


def fit_table(examples: DataFrame, documents: DataFrame | None = None, most_examples: int = 20_000, size: int = 1 << 16, **params) -> Model:
    """Fit on a table ``text, label``; at most ``most_examples`` rows in hash order reach the driver.

    Of ``documents``, all of them, only counts reach it.
    """
    rows = (examples.where(F.col("text").isNotNull() & F.col("label").isNotNull()).select("text", "label")
            .orderBy(F.xxhash64("text", "label"), "text", "label").limit(most_examples).collect())
    pairs = [(r.text, r.label) for r in rows]
    language = None
    if documents is not None and pairs:
        names = ordinary_names(documents.select("text").unionByName(examples.where("label = 'none'").select("text")), [t for t, s in pairs if s in CATEGORIES])
        language = Language(names, feature_rates(documents, names, size=size))
    return fit(pairs, language, size=size, **params)


def score_documents(documents: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, abuse, hate, sexual``: scores from 0 to 1 of every document, whole texts."""
    slim = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            values = scorer.texts(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(values[:, k]) for k in range(len(CATEGORIES))]], names=[key, *CATEGORIES])

    kind = slim.schema["_key"].dataType.simpleString()
    return slim.mapInArrow(score, f"{key} {kind}, " + ", ".join(f"{c} double" for c in CATEGORIES))


def flagged(scores: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """``key, category, score`` of the documents that reach a category's threshold."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score"), F.lit(model.thresholds[c]).alias("least")) for c in CATEGORIES]))
    return scores.select(key, each.alias("_c")).where("_c.score >= _c.least").select(key, "_c.category", "_c.score")


def rates_by_source(documents: DataFrame, scores: DataFrame, model: Model) -> DataFrame:
    """``source, category, documents, flagged, rate``; null sources are a group."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("category"), (F.col(c) >= model.thresholds[c]).cast("bigint").alias("hit")) for c in CATEGORIES]))
    return (documents.select("doc_id", "source").join(scores, "doc_id").select("source", each.alias("_c"))
            .groupBy("source", "_c.category").agg(F.count("*").alias("documents"), F.sum("_c.hit").alias("flagged"))
            .withColumn("rate", F.col("flagged") / F.col("documents")))
