"""Language of documents and of the stretches in them, by error-correcting output codes.

Each language has a codeword of bits. For every bit a binary n-gram classifier predicts
from a sentence which half of the languages it belongs to; decoding weighs the loss of
each bit against all codewords and takes the nearest, and calls a sentence ambiguous
where the second codeword is nearly as near.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylens.runtime import pick

LANGUAGES = ["de", "en", "es", "fr", "ko", "pt", "th", "vi"]
CODE_BITS, CODE_SEED = 15, 3
#: Sections a model is fitted on at most.
FIT_ROWS = 2000
_SAMPLE_PARTS = 1 << 20
#: Fewer words make no full sentence; in a script without word spaces, fewer letters.
MIN_WORDS, MIN_LETTERS = 4, 14
#: What a stretch is called whose language is none of those known.
UNDETERMINED = "und"
#: Share of a sentence's letter runs the model must know; and the share under which a loss for each bit beyond the last value is too much.
LEAST_KNOWN, WELL_KNOWN, MOST_LOSS = 0.3, 0.7, 0.1
#: Probability margin under which two languages count as equally near.
AMBIGUOUS = 0.2

# Common words of each language, the prior of its model.
COMMON_WORDS = {
    "de": "der die das und ist nicht ein eine einer einem einen mit für auf von zu im den des dem wird werden sich auch an als bei nach aus wenn oder kann noch über durch vor bis sind hat haben wurde ohne weil damit jeder jede muss soll beim zum zur falls sobald während solange nur schon zwischen gegen unter obwohl bevor nachdem wieder diese dieser dieses kein keine mehr",
    "en": "a the and of to in is that for it as with on be are this by from at or an not which have has was were will can must should when if until before after while because so only without every each any our their its than then there been into out about more also between over under again does do no but although where who what while once during both these those",
    "es": "el la los las de que y en un una por con para del se no es al lo como más su sus pero este esta cuando sin sobre entre también hasta desde donde todo todos toda cada porque aunque ya muy puede debe según antes después durante si son fue ha han ser está mientras solo cualquier ningún otra otro hay vez",
    "fr": "le la les des de du un une et en est que qui dans pour par sur avec ne pas plus au aux ce cette ces se sa son ses il elle nous vous ils mais ou où donc car si quand lorsque dès sans sous entre après avant pendant jusqu'à chaque tout toute tous toutes peut doit être sont été fait comme bien que même aucun parce tant encore afin seulement",
    "ko": "이 그 저 것 수 등 및 또는 그리고 하지만 때문에 위해 따라 대한 있는 없는 한다 된다 있다 없다 않는다 이다 하는 되는 모든 각 매 전에 후에 동안 때 까지 부터 에서 으로 에게 의 을 를 은 는 가 와 과 도 만 다시 즉시 우리 그것 아니다 같은 많은",
    "pt": "o a os as de do da dos das que e em um uma por com para no na nos nas se não é ao à aos mais seu sua seus mas este esta quando sem sobre entre também até desde onde todo todos toda cada porque embora já muito pode deve segundo antes depois durante são foi tem têm ser está enquanto só qualquer nenhum nenhuma outra outro há vez pelo pela fica logo assim",
    "th": "และ ที่ เป็น ใน ของ การ มี ไม่ ได้ จะ ให้ จาก กับ หรือ แต่ ถ้า เมื่อ ก่อน หลัง หลังจาก จนกว่า ทุก แต่ละ ต้อง แล้ว ว่า เพราะ โดย เพื่อ ตาม ทั้ง ระหว่าง แม้ว่า เท่านั้น อีก ใหม่ ทันที วัน ปี ตั้งแต่ เป็นต้นไป",
    "vi": "và của là có không được trong cho các một những với này khi để từ đến trên sau trước khi nếu thì mà cũng đã sẽ phải bị ra vào lại theo về tại do vì hoặc nhưng mỗi mọi tất cả cho đến khi ngay trong lúc chỉ vẫn còn đang nhiều ít nào đó như thế rất",
}
# Other notations of a language, in lower case.
NOTATIONS = {
    "de": "de deu ger german deutsch", "en": "en eng english", "es": "es spa spanish español espanol castilian", "fr": "fr fra fre french français francais",
    "ko": "ko kor korean 한국어", "pt": "pt por portuguese português portugues", "th": "th tha thai ไทย", "vi": "vi vie vietnamese việt tiếng việt",
}
_CODE_OF = {n: code for code, names in NOTATIONS.items() for n in names.split(" ")}
# Labels that name no language.
NO_LANGUAGE = {"", "-", "--", "?", "und", "mul", "mis", "zxx", "unknown", "none", "null", "n/a", "na", "undefined", "other", "xx"}


def label_code(label: str | None) -> str | None:
    """The two-letter code a label stands for; None if it names no language, itself in lower case if an unknown one."""
    text = (label or "").strip().lower()
    if text in NO_LANGUAGE:
        return None
    return _CODE_OF.get(text) or _CODE_OF.get(re.split(r"[-_ ;,.]", text)[0]) or text


def codewords(languages: list[str] = LANGUAGES, bits: int = CODE_BITS, seed: int = CODE_SEED) -> np.ndarray:
    """One row of +1/-1 bits for each language: of many random codes that with the greatest least distance."""
    rng = np.random.default_rng(seed)
    best, best_key = None, None
    for _ in range(400):
        code = rng.choice([-1, 1], (len(languages), bits))
        while len(languages) > 1 and (same := abs(code.sum(0)) == len(languages)).any():
            code[:, same] = rng.choice([-1, 1], (len(languages), same.sum()))  # a bit that is equal for all languages says nothing
        apart = [(code[i] != code[j]).sum() for i in range(len(languages)) for j in range(i)]
        key = (min(apart), sum(apart))
        if best_key is None or key > best_key:
            best, best_key = code, key
    return best


_FENCE = re.compile(r"(?:```|~~~).*?(?:```|~~~|\Z)", re.S)
_INLINE = re.compile(r"`[^`\n]*`")
_TABLE = re.compile(r"^\s*\|.*$|^[\s|:\-]*\|[\s|:\-]*$", re.M)
_TAG = re.compile(r"<[/!]?[A-Za-z][^<>\n]*>|https?://\S+|\S+@\S+")
_BULLET = re.compile(r"^\s*(?:[-*+•>#]+|\d+[.)])\s+", re.M)
_KEYED = re.compile(r"^\s*[\w.]+\s*[:=]\s*(?=\S)", re.M)
_IDENTIFIER = regex.compile(r"(?<![\w.])(?:\w+(?:[._]\w+)+|\w*\d\w*|[a-z]+[A-Z]\w*|[A-Z][a-z]+[A-Z]\w*)(?![\w])")
_SENTENCE = regex.compile(r"(?<=[.!?…。！？])[\"'”’)]*\s+|\n+")
_TURN = regex.compile(r"(?<=\p{Thai}[\d\s.,)]*)\s+(?=\p{Latin})|(?<=\p{Latin}[\d.,!?)]*)\s+(?=\p{Thai})")
_WORD = regex.compile(r"[\p{L}\p{M}]+")
_UNSPACED = regex.compile(r"\p{Thai}")


def sentences(body: str | None) -> list[str]:
    """The sentences of the prose of a body: no code, tables, tags, list labels; blanks for identifiers."""
    if not body:
        return []
    text = unicodedata.normalize("NFC", body.replace("\r\n", "\n"))
    for pattern, mark in ((_FENCE, "``~~"), (_INLINE, "`"), (_TABLE, "|"), (_TAG, "</@"), (_BULLET, ""), (_KEYED, ":=")):
        if not mark or any(c in text for c in mark):
            text = pattern.sub(" ", text)
    text = _IDENTIFIER.sub(" ", text)
    return [y for x in _SENTENCE.split(text) if x and x.strip() for y in _by_script(x.strip())]


def _by_script(sentence: str) -> list[str]:
    """Cut where an unspaced script, which ends sentences without a mark, meets another; fragments stay with what precedes."""
    if not _UNSPACED.search(sentence):
        return [sentence]
    parts: list[str] = []
    for part in _TURN.split(sentence):
        if parts and not (is_full(part) and is_full(parts[-1])):
            parts[-1] += " " + part
        else:
            parts.append(part)
    return parts


def full_words(sentence: str) -> list[str] | None:
    """The words of a full sentence in lower case; None for a fragment."""
    words = _WORD.findall(sentence.lower())
    if len(words) >= MIN_WORDS and not _UNSPACED.search(sentence):
        return words
    unspaced = [w for w in words if _UNSPACED.search(w)]
    return words if sum(map(len, unspaced)) >= MIN_LETTERS or len(words) - len(unspaced) >= MIN_WORDS else None


def is_full(sentence: str) -> bool:
    return full_words(sentence) is not None


def _plain(text: str) -> str:
    """Without accents, as they are lost in some notations."""
    out = text.replace("đ", "d").replace("ß", "ss")
    return "".join(c for c in unicodedata.normalize("NFD", out) if not unicodedata.combining(c) or "฀" <= c <= "๿")


def _spelled(text: str) -> str:
    """With two letters for an umlaut."""
    return text.replace("ä", "ae").replace("ö", "oe").replace("ü", "ue").replace("ß", "ss")


def word_grams(word: str) -> Counter:
    """Letter runs of one to four of a word in lower case, and the word itself."""
    found: Counter = Counter()
    if _UNSPACED.search(word):
        padded = word
    else:
        padded = f" {word} "
        found[padded] += 2
    for n in (1, 2, 3, 4):
        for i in range(len(padded) - n + 1):
            found[padded[i : i + n]] += 1
    return found


#: Words whose part in the margins a worker remembers; beyond it the memory is emptied, results do not change.
REMEMBERED = 200_000
#: Weight of all runs of a sentence together.
SENTENCE_WEIGHT = 12.0


class OutputCodeModel:
    """A logistic n-gram classifier for each bit of the codewords, all fitted together."""

    def __init__(self, languages: list[str] = LANGUAGES):
        self.languages, self.code = list(languages), codewords(list(languages))
        self.index: dict[str, int] = {}
        self.weights = np.zeros((0, self.code.shape[1]), np.float32)
        self._forget()

    def _forget(self) -> None:
        self._words: dict[str, int] = {}  # rows of the words met so far
        self._parts = np.zeros((1024, self.code.shape[1] + 2))  # margins, known runs and all runs of a word

    def learn(self, samples: list[tuple[str, list[str]]], epochs: int = 4, rate: float = 1.0, batch: int = 64, seed: int = 5) -> OutputCodeModel:
        """Gradient steps over batches of samples (language, words), with one step size for each n-gram that shrinks as it is used."""
        index, held = self.index, {}

        def part(word: str) -> tuple[np.ndarray, np.ndarray]:
            if word not in held:
                found = word_grams(word)
                held[word] = np.array([index.setdefault(g, len(index)) for g in found], np.int64), np.array(list(found.values()), np.float32)
            return held[word]

        samples = [(g, words) for g, words in samples if words]
        parts = [[part(w) for w in words] for _, words in samples]
        places, values = [np.concatenate([x for x, _ in p]) for p in parts], [np.concatenate([n for _, n in p]) for p in parts]
        values = [v * (SENTENCE_WEIGHT / v.sum()) for v in values]
        words = np.array([self.code[self.languages.index(g)] for g, _ in samples], np.float32).reshape(-1, self.code.shape[1])
        self.weights = np.zeros((len(index), self.code.shape[1]), np.float32)
        used = np.full(len(index), 1e-3, np.float32)
        rng = np.random.default_rng(seed)
        for _ in range(epochs):
            order = rng.permutation(len(words))
            for at in range(0, len(order), batch):
                rows = order[at : at + batch]
                sizes = np.array([len(places[k]) for k in rows])
                place, value = np.concatenate([places[k] for k in rows]), np.concatenate([values[k] for k in rows])
                word = words[rows]
                margin = word * np.add.reduceat(value[:, None] * self.weights[place], np.r_[0, np.cumsum(sizes)[:-1]])
                push = word / (1 + np.exp(np.clip(margin, -30, 30)))
                owner = np.repeat(np.arange(len(rows)), sizes)
                by = np.argsort(place, kind="stable")
                own, first = np.unique(place[by], return_index=True)
                steps = np.add.reduceat(value[by, None] * push[owner[by]], first)
                used[own] += np.add.reduceat((value * value * (push * push).mean(1)[owner])[by], first)
                self.weights[own] += rate * steps / np.sqrt(used[own])[:, None]
        self._forget()
        return self

    def _number(self, word: str) -> int:
        """The row of a word among the remembered ones."""
        number = self._words.get(word)
        if number is None:
            number = self._words[word] = len(self._words)
            if number >= len(self._parts):
                self._parts = np.concatenate([self._parts, np.zeros_like(self._parts)])
            found = word_grams(word)
            known = [(self.index[g], n) for g, n in found.items() if g in self.index]
            part = self._parts[number]
            if known:
                at, n = map(np.array, zip(*known))
                part[:-2], part[-2] = n @ self.weights[at].astype(float), n.sum()
            part[-1] = sum(found.values())
        return number

    def decode_all(self, sentences: list[list[str]]) -> list[tuple[str, float, bool]]:
        """(language, confidence, ambiguous) for each list of words: the codeword of least logistic loss over all bits.

        A sentence is ambiguous where the second codeword is nearly as near. It is of an
        undetermined language where the model knows few of its runs, or not most of them and
        even the nearest codeword is far.
        """
        if not sentences:
            return []
        if len(self._words) > REMEMBERED:
            self._forget()
        sizes = np.array([len(w) for w in sentences])
        numbers = np.fromiter((self._number(w) for words in sentences for w in words), np.int64, int(sizes.sum()))
        total = np.add.reduceat(self._parts[numbers], np.r_[0, np.cumsum(sizes)[:-1]])
        known, runs = total[:, -2], total[:, -1]
        margin = total[:, :-2] * (SENTENCE_WEIGHT / np.maximum(known, 1))[:, None]
        loss = np.logaddexp(0, -self.code[None] * margin[:, None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, 1, kind="stable")
        first, second = (np.take_along_axis(p, order[:, k : k + 1], 1)[:, 0] for k in (0, 1))
        ambiguous = first - second < AMBIGUOUS
        unknown = (known < LEAST_KNOWN * runs) | (known < WELL_KNOWN * runs) & (loss.min(1) > MOST_LOSS * self.code.shape[1])
        return [(UNDETERMINED if u else self.languages[k], float(f), bool(a)) for k, f, a, u in zip(order[:, 0], first, ambiguous, unknown)]

    def decode(self, sentence: str) -> tuple[str, float, bool]:
        """The same for one sentence."""
        return self.decode_all([_WORD.findall(sentence.lower()) or [""]])[0]


def _forms(language: str, text: str) -> set[str]:
    low = text.lower()
    return {low, _plain(low), _spelled(low)} if language == "de" else {low, _plain(low)}


def _known_forms(words: str, language: str) -> set[str]:
    return {f for form in _forms(language, words) for f in form.split()}


_COMMON = {g: _known_forms(words, g) for g, words in COMMON_WORDS.items()}
_SCRIPTS = {"ko": regex.compile(r"\p{Hangul}"), "th": regex.compile(r"\p{Thai}")}


def vote(words: list[str], languages: list[str] = LANGUAGES) -> tuple[str | None, bool]:
    """(language, clear): that of most common words, or of the script where only one language has it; None on a tie."""
    letters = sum(map(len, words))
    for g, script in _SCRIPTS.items():
        if g in languages and letters and sum(len(w) for w in words if script.search(w)) > letters / 2:
            return g, True
    hits = sorted(((sum(w in _COMMON[g] for w in words), g) for g in languages if g in _COMMON and g not in _SCRIPTS), reverse=True)
    (first, g), (second, _) = [*hits, (0, ""), (0, "")][:2]
    return (g if first >= 2 and first > second else None), first >= 4 and first >= 2 * second


def fit(rows: list[tuple[str | None, str | None]], seed: int = 5, languages: list[str] = LANGUAGES, common_words: dict[str, str] = COMMON_WORDS) -> OutputCodeModel:
    """A model of ``languages`` from (label, body) rows whose labels may be missing or wrong.

    It learns the common words of each language, and the full sentences on which the label
    of the section and the vote of common words agree, or whose vote is clear; so wrong
    labels and foreign stretches teach nothing. Languages without common words learn from
    sentences whose label names them and for which no other language votes.
    """
    known = []
    for g in languages:
        words = common_words.get(g, "").split()
        known += [(g, f.split()) for k in range(0, len(words), 6) for f in sorted(_forms(g, " ".join(words[k : k + 6])))]
    taught = []
    for label, body in rows:
        code = label_code(label)
        for s in sentences(body):
            words = full_words(s)
            if words:
                language, clear = vote(words, languages)
                if language is None and code in languages and code not in common_words:
                    language = code
                if language and (clear or language == code):
                    taught += [(language, _WORD.findall(f)) for f in sorted(_forms(language, s))]
    return OutputCodeModel(languages).learn([*known, *taught], seed=seed)


Segment = tuple[str, str, float, bool, int]


def segments(model: OutputCodeModel, bodies: list[str | None]) -> list[list[Segment]]:
    """For each body (text, language, confidence, ambiguous, full sentences) of each stretch of one language.

    Fragments that make no full sentence join the stretch before them, or the one after at
    the start; a body without any full sentence has no stretch. Sentences of an undetermined
    language make stretches of their own.
    """
    split = [[(s, full_words(s)) for s in sentences(b)] for b in bodies]
    decoded = iter(model.decode_all([w for body in split for _, w in body if w]))
    out = []
    for body in split:
        found: list[list] = []
        waiting: list[str] = []
        for s, words in body:
            if not words:
                (found[-1][0] if found else waiting).append(s)
                continue
            language, confidence, ambiguous = next(decoded)
            if found and found[-1][1] == language:
                found[-1][0].append(s)
                found[-1][2].append((confidence, ambiguous))
            else:
                found.append([[*waiting, s], language, [(confidence, ambiguous)]])
                waiting = []
        out.append([(" ".join(t), g, sum(c for c, _ in cs) / len(cs), all(a for _, a in cs), len(cs)) for t, g, cs in found])
    return out


def _sections(sections: DataFrame) -> DataFrame:
    """(section_id, lang, body) of the latest extraction of each section; ties take the greater body."""
    rows = pick(sections, "section_id", "lang", "body", "extracted_at").where("section_id is not null")
    return rows.groupBy("section_id").agg(F.max(F.struct("extracted_at", "body", "lang")).alias("r")).select("section_id", "r.lang", "r.body")


def language_segments(sections: DataFrame, fit_rows: int = FIT_ROWS, languages: list[str] = LANGUAGES) -> DataFrame:
    """The stretches of one language in each section.

    Out: section_id, label (the language its label names, null for none), segment (from
    0), lang (``und`` where it is none of ``languages``), confidence, ambiguous,
    full_sentences, text. Sections without prose (null, blank, code and tables only) give no
    rows. The model is fitted on at most 2 * ``fit_rows`` extractions, spread evenly by a hash.
    """
    rows = _sections(sections)
    bodies = pick(sections, "lang", "body").where("body is not null")
    parts = F.pmod(F.xxhash64("body"), F.lit(_SAMPLE_PARTS)) < F.lit(min(_SAMPLE_PARTS, -(-fit_rows * _SAMPLE_PARTS // max(1, bodies.count()))))
    sample = bodies.where(parts).limit(2 * fit_rows).collect()
    model = fit(sorted(((r.lang, r.body) for r in sample), key=str), languages=languages)
    shared = sections.sparkSession.sparkContext.broadcast(model)  # n-grams of 2 * fit_rows sections at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = ["section_id", "label", "segment", "lang", "confidence", "ambiguous", "full_sentences", "text"]
        kinds = [None, pa.string(), pa.int32(), pa.string(), pa.float64(), pa.bool_(), pa.int32(), pa.string()]
        for batch in batches:
            out = []
            ids, labels, texts = (c.to_pylist() for c in batch.columns)
            for key, label, parts in zip(ids, labels, segments(own, texts)):
                code = label_code(label)
                out += [(key, code, k, g, c, a, n, t) for k, (t, g, c, a, n) in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k] or batch.column(0).type) for k in range(len(names))], names)

    kind = rows.schema["section_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"section_id {kind}, label string, segment int, lang string, confidence double, ambiguous boolean, full_sentences int, text string")


def found(sections: DataFrame) -> DataFrame:
    """(section_id, lang): the languages of sections whose label is missing or wrong, or that hold several.

    Stretches of an undetermined language name none; a section with no others gives no rows.
    """
    known = language_segments(sections).where(F.col("lang") != UNDETERMINED)
    held = known.groupBy("section_id").agg(F.collect_set("lang").alias("langs"), F.max("label").alias("label"))
    cases = held.where((F.size("langs") > 1) | F.col("label").isNull() | ~F.array_contains("langs", F.col("label")))
    return cases.select("section_id", F.explode("langs").alias("lang"))
