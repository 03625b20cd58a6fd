"""Languages of documents and of their stretches, by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the
sum, over all ways to cut the word into pieces, of the product of the pieces' probabilities; a forward pass over the
word gives it. A text's is the product over its words, so words are scored once and looked up after that.

The pieces' probabilities are fitted on the driver by expectation maximisation, on a sample of labelled documents of
about FIT_ROWS rows and up to FIT_CHARS characters each (chosen by a hash of the key; the only bounded step). Labels may be wrong: after a first fit the
sample's documents are cut into stretches by it, as below, and the fit is repeated on those. A few function words of
each language anchor the fit where the sample lacks one.

Texts are cut at sentence and line ends. The best path through a document's units, with a cost for each change of
language, gives its stretches. Lines that are mainly figures or symbols, and short lines outside of sentences, are no
running text. A language counts in a document from MIN_CHARS characters of running text.

Null, empty and blank texts have no language. A label that resolves to no known language is missing. Repeated rows give
one row each. Extra columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.grams import slices

VOCABULARY = "piece_bpe_32k.model"
FIT_ROWS = 2000
#: Characters of each sampled row that the fit reads, a bound on the sample like FIT_ROWS; scoring reads all of all rows.
FIT_CHARS = 20_000
MIN_CHARS = 150
#: Nats that a change of language costs, and the most that one word may speak against a language.
SWITCH = 20.0
WORD_CAP = 6.0
MAX_WORD = 20
MAX_PIECE = 12
MEMO = 300_000

LANGUAGES = ("en", "de", "fr", "es", "it", "pt", "nl", "sv", "pl", "ja")
# Codes and names of the languages.
NAMES = {
    "en": "en eng english englisch anglais inglés ingles inglese inglês engels engelska angielski 英語",
    "de": "de deu ger german deutsch allemand alemán aleman tedesco alemão alemao duits tyska niemiecki ドイツ語",
    "fr": "fr fra fre french französisch franzoesisch français francais francés frances francese francês frans franska francuski フランス語",
    "es": "es spa spanish spanisch espagnol español espanol castellano castilian spagnolo espanhol spaans spanska hiszpański スペイン語",
    "it": "it ita italian italienisch italien italiano italiaans italienska włoski イタリア語",
    "pt": "pt por portuguese portugiesisch portugais portugués portugues portoghese português portugees portugisiska portugalski ポルトガル語",
    "nl": "nl nld dut dutch niederländisch niederlaendisch néerlandais neerlandés olandese holandês neerlandês nederlands flemish vlaams nederländska holenderski オランダ語",
    "sv": "sv swe swedish schwedisch suédois sueco svedese zweeds svenska szwedzki スウェーデン語",
    "pl": "pl pol polish polnisch polonais polaco polacco polonês pools polska polski ポーランド語",
    "ja": "ja jpn jp japanese japanisch japonais japonés giapponese japonês japans japanska japoński nihongo 日本語",
}
# Frequent function words that anchor each language.
ANCHORS = {
    "en": "the of and to in is that for it was on with as are by this be at from which have not or an will has we our its were than after while under",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se le ce il sont la avec son une aux été cette ses mais comme nous ont",
    "es": "de la que el en y a los del se las por un para con no una su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre ha",
    "it": "di e il la che in a per un è del non una i con si le da della dei al sono alla nel gli più ha come anche dal delle o ma lo se nella questo",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er die ook als door om bij naar uit worden hij tot maar over nog heeft wordt dan onze wij deze",
    "sv": "och i att det som en på är av för med till den har de inte om ett han men var jag sig från vi så kan när år under också efter eller nu sin där vid",
    "pl": "w i na z się nie do to że jest o jak za od po przez a co dla ale ma oraz jego tym przy tego są być tylko czy był roku które już jako może",
    "ja": "の に は を た が で て と し れ さ ある いる も する から な こと として い や など なっ ない この ため その あっ よう また もの という あり まで られ なる へ か だ これ によって により おり より による ず なり られる において",
}
_LABELS = {name: lang for lang, names in NAMES.items() for name in names.split()}
_INDEX = {lang: i for i, lang in enumerate(LANGUAGES)}

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+|(?<=[。！？])")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠﻿]")


def label_language(label: str | None) -> str | None:
    """The language a label names: by code, region or name in any spelling; None for placeholders."""
    if not label:
        return None
    parts = re.split(r"[^\w]+|_", unicodedata.normalize("NFC", label.strip().lower()))
    return next((_LABELS[p] for p in parts if p in _LABELS), None)


def plain(text: str) -> str:
    """Lower case, compatibility forms folded, invisible characters dropped; what is scored, never what is counted."""
    if not text.isascii():
        text = _INVISIBLE.sub("", unicodedata.normalize("NFKC", text))
    return text.lower()


def units(text: str) -> list[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences and lines of a text that are running text, not figures or labels."""
    out, at, open_sentence = [], 0, False
    for line in text.split("\n"):
        body = line.strip()
        if body:
            cuts = [m.span() for m in _SENTENCE_END.finditer(line) if m.end() < len(line)]
            parts = zip([0, *(e for _, e in cuts)], [*(b for b, _ in cuts), len(line)])
            found = [(at + b, at + e, cut_words(line[b:e])) for b, e in parts]
            letters = sum(map(len, chain.from_iterable([words for _, _, words in found])))
            blanks = body.count(" ")
            running = letters >= 0.55 * (len(body) - blanks) and "\t" not in body and (open_sentence or letters >= 15 and (blanks >= 3 or not body.isascii()))
            if running:
                out += found
            open_sentence = running and body[-1] not in ".!?。！？:;"
        else:
            open_sentence = False
        at += len(line) + 1
    return out


class Model:
    """Piece probabilities of each language, and the words scored so far."""

    def __init__(self, pieces: list[str], probability: np.ndarray):
        self.row = {p: i for i, p in enumerate(pieces)}
        self.unknown, self.never = len(pieces), len(pieces) + 1
        self.probability = probability
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.fresh: list[np.ndarray] = []
        self.scores = np.zeros((0, len(LANGUAGES)))

    def lattice(self, words: list[str]) -> np.ndarray:
        """rows[w, end, length]: the piece of that length that ends there. The words are of one size."""
        size = len(words[0]) + 1
        rows = np.full((len(words), size + 1, MAX_PIECE + 1), self.never, np.int32)
        row = self.row
        spans = [(end, n) for end in range(1, size + 1) for n in range(1, min(end, MAX_PIECE) + 1)]
        for w, word in enumerate(words):
            m = "▁" + word
            for end, n in spans:
                r = row.get(m[end - n : end])
                if r is not None:
                    rows[w, end, n] = r
        single = rows[:, 1:, 1]
        single[single == self.never] = self.unknown
        return rows

    def forward(self, rows: np.ndarray) -> np.ndarray:
        """alpha[w, end, language]: the probability of a word's prefix over all its segmentations."""
        alpha = np.zeros((*rows.shape[:2], self.probability.shape[1]))
        alpha[:, 0] = 1
        for end in range(1, rows.shape[1]):
            for n in range(1, min(end, MAX_PIECE) + 1):
                alpha[:, end] += alpha[:, end - n] * self.probability[rows[:, end, n]]
        return alpha

    def expected(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected count of every piece in each language, given counts[w, language] of the words."""
        alpha = self.forward(rows)
        beta = np.zeros_like(alpha)
        beta[:, -1] = 1
        for begin in range(rows.shape[1] - 2, -1, -1):
            for n in range(1, min(rows.shape[1] - 1 - begin, MAX_PIECE) + 1):
                beta[:, begin] += beta[:, begin + n] * self.probability[rows[:, begin + n, n]]
        weight = counts / np.maximum(alpha[:, -1], 1e-300)
        size, k = self.probability.shape
        at, parts = [], []
        for end in range(1, rows.shape[1]):
            for n in range(1, min(end, MAX_PIECE) + 1):
                r = rows[:, end, n]
                used = np.flatnonzero(r != self.never)
                r = r[used]
                at.append(r)
                parts.append(alpha[used, end - n] * self.probability[r] * beta[used, end] * weight[used])
        flat = np.concatenate(at)[:, None] * k + np.arange(k)
        return np.bincount(flat.ravel(), np.concatenate(parts).ravel(), size * k).reshape(size, k)

    def look_up(self, words: list[str]) -> np.ndarray:
        """Row numbers in scores of the words; new ones are scored together."""
        memo = self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if new:
            if len(memo) + len(new) > MEMO and memo:
                self.forget()
                return self.look_up(words)
            for some in same_sizes(new):
                rows = self.lattice(some)
                s = np.log(np.maximum(self.forward(rows)[:, -1], 1e-300))
                memo.update(zip(some, range(len(memo), len(memo) + len(some))))
                self.fresh.append(np.maximum(s, s.max(axis=1, keepdims=True) - WORD_CAP))
            self.scores = np.concatenate([self.scores, *self.fresh])
            self.fresh = []
        return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))

    def unit_scores(self, words: list[list[str]]) -> np.ndarray:
        """[unit, language]: log probabilities of each unit's words; zeros for a unit without words."""
        sizes = np.array([len(w) for w in words], np.int64)
        out = np.zeros((len(words), len(LANGUAGES)))
        if sizes.sum():
            rows = self.look_up(list(chain.from_iterable(words)))
            some = np.flatnonzero(sizes)
            begin = np.cumsum(sizes) - sizes
            out[some] = np.add.reduceat(self.scores[rows], begin[some])
        return out


def same_sizes(words: list[str], most: int = 4000) -> Iterator[list[str]]:
    """The words in groups of one size."""
    by: dict[int, list[str]] = defaultdict(list)
    for w in words:
        by[len(w)].append(w)
    for some in by.values():
        for b in range(0, len(some), most):
            yield some[b : b + most]


def cut_words(text: str) -> list[str]:
    """Words of letters, long ones (and runs without blanks) cut to MAX_WORD letters."""
    found = _WORD.findall(plain(text))
    if not found or max(map(len, found)) <= MAX_WORD:
        return found
    return [w[i : i + MAX_WORD] for w in found for i in range(0, len(w), MAX_WORD)]


def read_pieces(path: str | None = None) -> list[str]:
    """The pieces of a sentencepiece vocabulary that text can be cut into, without its control and byte pieces."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or str(public_tokenizers.path(VOCABULARY)))
    all_ids = range(model.get_piece_size())
    return [model.id_to_piece(i) for i in all_ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


def fit(sample: list[tuple[str, str | None]], pieces: list[str], rounds: int = 2) -> Model:
    """A model from labelled texts; see above."""
    n = len(LANGUAGES)
    start = np.full((len(pieces) + 2, n), 1e-5)
    start[: len(pieces)] = 1e-4 * np.array([len(p) for p in pieces], float)[:, None]
    start[-1] = 0
    model = Model(pieces, start / start.sum(axis=0))
    known = {label: _INDEX.get(label_language(label), -1) for label in {label for _, label in sample}}
    documents = [(own, known[label]) for text, label in sample if text and (own := [words for _, _, words in units(text) if words])]
    said = [(words, lang) for own, lang in documents for words in own]
    anchors = [(words.split(), _INDEX[lang]) for lang, words in ANCHORS.items() for _ in range(20)]
    lattices: dict[str, tuple[list[str], np.ndarray]] = {}
    for turn in range(rounds):
        counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(n))
        for lang in range(n):
            for w, k in Counter(chain.from_iterable(words for words, own in chain(said, anchors) if own == lang)).items():
                counts[w][lang] += k
        if not lattices:
            lattices = {some[0]: (some, model.lattice(some)) for some in same_sizes(list(counts))}
        nothing = np.zeros(n)
        tables = {k: np.array([counts.get(w, nothing) for w in some]) for k, (some, _) in lattices.items()}
        for _ in range(2):
            seen = sum(model.expected(rows, tables[k]) for k, (_, rows) in lattices.items())
            own = seen / np.maximum(seen.sum(axis=0), 1)
            base = own.mean(axis=1, keepdims=True) + 1e-8
            # languages with little text lean on the average of all
            lean = np.maximum(200.0 / (200.0 + seen.sum(axis=0)), 0.01)
            model.probability = (1 - lean) * own + lean * base
            model.probability[model.unknown] = 1e-7
            model.probability[model.never] = 0
        model.forget()
        if turn < rounds - 1:
            scores, at, said = model.unit_scores([words for own, _ in documents for words in own]), 0, []
            for own, _ in documents:
                said += zip(own, path(scores[at : at + len(own)]).tolist())
                at += len(own)
    return model


def path(scores: np.ndarray) -> np.ndarray:
    """The language of each unit on the best path."""
    total, back = scores[0].copy(), []
    for s in scores[1:]:
        best = int(total.argmax())
        move = total[best] - SWITCH > total
        back.append(np.where(move, best, np.arange(len(total))))
        total = np.where(move, total[best] - SWITCH, total) + s
    out = [int(total.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return np.array(out[::-1])


def stretches(model: Model, texts: list[str | None]) -> list[list[tuple[int, int, int, int, float]]]:
    """For each text its stretches of running text: (start, end, n_chars, language, confidence).

    confidence: the language's posterior among all, with equal priors, per ten words of the stretch at most, so that it
    doesn't saturate with length.
    """
    cut = [units(t) if t else [] for t in texts]
    sizes = np.array([len(u) for u in cut])
    scores = model.unit_scores([words for us in cut for _, _, words in us])
    ends = np.cumsum(sizes)
    begin = ends - sizes
    some = np.flatnonzero(sizes)
    plainly = np.zeros(len(texts), bool)
    main = np.zeros(len(texts), int)
    if len(some):
        total = np.add.reduceat(scores, begin[some])
        main[some] = total.argmax(axis=1)
        doubt = scores.max(axis=1) - scores[np.arange(len(scores)), np.repeat(main, sizes)]
        plainly[some] = np.add.reduceat(doubt, begin[some]) <= SWITCH
    out = []
    for d, us in enumerate(cut):
        own = scores[begin[d] : ends[d]]
        if not us:
            out.append([])
            continue
        langs = np.full(len(us), main[d]) if plainly[d] else path(own)
        found, k = [], 0
        while k < len(us):
            j = k
            while j < len(us) and langs[j] == langs[k]:
                j += 1
            evidence = own[k:j].sum(axis=0)
            n_words = max(1, sum(b - a for a, b, _ in us[k:j]) // 6)
            odds = (evidence - evidence[langs[k]]) * min(1.0, 10 / n_words)
            n_chars = sum(b - a for a, b, _ in us[k:j]) + (j - k - 1)
            found.append((us[k][0], us[j - 1][1], n_chars, int(langs[k]), float(1 / np.exp(np.minimum(odds, 50)).sum())))
            k = j
        out.append(found)
    return out


def fitted(documents: DataFrame, vocabulary: str | None = None, fit_rows: int = FIT_ROWS, fit_chars: int = FIT_CHARS) -> Model:
    """A model fitted on about fit_rows labelled rows, chosen by a hash of doc_id, and the first fit_chars characters of each."""
    share = min(1.0, fit_rows / max(1, documents.count()))
    some = documents.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = some.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(F.substring("text", 1, fit_chars).alias("text"), "lang").collect()
    return fit([(r.text, r.lang) for r in rows], read_pieces(vocabulary))


def _scanned(documents: DataFrame, schema: str, rows_of, vocabulary: str | None, fit_rows: int, model: Model | None) -> DataFrame:
    """rows_of(doc_id, label, stretches) for each document, with the given model or one fitted on them, sent to every task."""
    model = model or fitted(documents, vocabulary, fit_rows)
    shipped = documents.sparkSession.sparkContext.broadcast((list(model.row), model.probability))
    names = [f.split()[0] for f in schema.split(", ")]
    types = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}[f.split()[1]] for f in schema.split(", ")]

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in it:
            own = own or Model(*shipped.value)
            ids, labels, texts = (batch.column(c).to_pylist() for c in range(3))
            for part in slices(texts):
                found = stretches(own, [texts[i] for i in part])
                rows = [r for i, f in zip(part, found) for r in rows_of(ids[i], labels[i], f)]
                columns = list(zip(*rows)) if rows else [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return documents.select("doc_id", "lang", "text").mapInArrow(scan, schema)


def segments(documents: DataFrame, vocabulary: str | None = None, fit_rows: int = FIT_ROWS, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_label, start, end, n_chars, lang, confidence): each stretch of one language of every document."""

    def rows_of(doc, label, found):
        return [(doc, label, a, b, n, LANGUAGES[lang], confidence) for a, b, n, lang, confidence in found]

    schema = "doc_id long, lang_label string, start int, end int, n_chars int, lang string, confidence double"
    return _scanned(documents, schema, rows_of, vocabulary, fit_rows, model)


def document_languages(documents: DataFrame, vocabulary: str | None = None, fit_rows: int = FIT_ROWS, min_chars: int = MIN_CHARS, model: Model | None = None) -> DataFrame:
    """(doc_id, lang_label, lang, n_chars, confidence, n_langs): the languages that count in each document."""

    def rows_of(doc, label, found):
        chars, sure = Counter(), Counter()
        for _, _, n, lang, confidence in found:
            chars[lang] += n
            sure[lang] += n * confidence
        counted = [lang for lang, n in chars.items() if n >= min_chars]
        return [(doc, label, LANGUAGES[k], chars[k], sure[k] / chars[k], len(counted)) for k in counted]

    schema = "doc_id long, lang_label string, lang string, n_chars int, confidence double, n_langs int"
    return _scanned(documents, schema, rows_of, vocabulary, fit_rows, model)


def mislabelled(languages: DataFrame) -> DataFrame:
    """The rows of document_languages whose document has a missing or wrong label or more than one language."""
    known = F.create_map(*[F.lit(x) for kv in _LABELS.items() for x in kv])
    words = F.filter(F.split(F.lower(F.trim(F.coalesce("lang_label", F.lit("")))), r"[^\p{L}\p{N}]+|_"), lambda w: F.try_element_at(known, w).isNotNull())
    named = F.try_element_at(known, F.try_element_at(words, F.lit(1)))
    return languages.withColumn("named", named).filter(F.col("named").isNull() | (F.col("named") != F.col("lang")) | (F.col("n_langs") > 1)).drop("named")
