"""Visually identical text in one consistent form.

After folding what is invisible (width forms, ligatures, kinds of space, ignorable characters,
composition of accents), every letter stands for the class of letters that look like it. A word
becomes a lattice of the letters its classes could be; the path with the best character n-gram
score under one consistent script is chosen by Viterbi search. The lattice depends on the looks
of a word alone, so words that look alike always come out equal, and classes hold look-alikes
only, so words that can be told apart stay different.

Defined results: null stays null; case, accents, superscripts and digits are kept; a zero-width
joiner inside an emoji is visible and kept; ties go to the first script in the order of SCRIPTS.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCRIPTS = ("latin", "cyrillic", "greek", "armenian")
#: Letters that look like a Latin letter, by script. Equal places look alike; a blank has no look-alike.
LATIN = "a c e o p s x y i j h d q w v n u g l A B C E H I J K M N O P S T X Y Z F G V"
ALIKE = {
    "cyrillic": "а с е о р ѕ х у і ј һ ԁ ԛ ԝ ѵ . . . ӏ А В С Е Н І Ј К М . О Р Ѕ Т Х Ү . . Ԍ Ѵ",
    "greek": "α . . ο ρ . . . ι ϳ . . . . ν . υ . . Α Β Ϲ Ε Η Ι . Κ Μ Ν Ο Ρ . Τ Χ Υ Ζ Ϝ . .",
    "armenian": "\u0251 . . օ . ѕ . . . յ հ ԁ զ . . ո ս ց . . . . . . . . . . . Օ . Տ . . . . . . .",
}
#: Armenian look-alikes that are plain enough to count; the rest of that row is left out of the classes.
ARMENIAN_USED = "օհոսցՕՏ"
#: Further single characters drawn alike.
SAME_LOOK = {
    "‐": "-", "‑": "-", "µ": "μ", "\u212a": "K", "\u212b": "Å", "\u0261": "g", "\u0251": "a",
    "ⅼ": "l", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
}
_SWITCH = -12.0
_MARKS = r"\u0300-\u036f"
_WORD = re.compile(rf"[^\W\d_][\w{_MARKS}]*")
_IGNORED = r"\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b\u200c\u200e\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufe00-\ufe0e\ufeff\ufff9-\ufffb"
_SPACES = r"\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"
_PICTURE = r"☀-➿\U0001f000-\U0001faff"
_JOINER = re.compile(rf"(?<![{_PICTURE}\ufe0f])\u200d|\u200d(?![{_PICTURE}])")
_WIDTH = re.compile(r"[\uff01-\uffeeﬀ-ﬆ]+")
_SPECIAL = re.compile(rf"[{_IGNORED}{_SPACES}\u200d\uff01-\uffeeﬀ-ﬆ‐‑µ\u212a\u212b\u0261\u0251ⅼⅰⅴⅹⅽ-ⅿ]")
_IGNORED, _SPACES = re.compile(f"[{_IGNORED}]"), re.compile(f"[{_SPACES}]")
#: Letters of scripts other than Latin that may stand in a word.
_OTHER = re.compile(r"[Ͱ-֏ἀ-\u1fff]")


def _classes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Letter to the Latin letter it looks like, and that letter to its forms by script."""
    look, forms = {}, {x: {"latin": x} for x in LATIN.split()}
    for script, row in ALIKE.items():
        for latin, other in zip(LATIN.split(), row.split(), strict=True):
            if other != "." and (script != "armenian" or other in ARMENIAN_USED):
                look[other] = latin
                forms[latin][script] = other
    return look, {k: v for k, v in forms.items() if len(v) > 1}


LOOK, FORMS = _classes()
_LOOK, _SAME = str.maketrans(LOOK), str.maketrans(SAME_LOOK)
_ALIKE = re.compile(f"[{''.join(sorted(LOOK))}]")
#: Words of classes alone: only these, and words with a letter of another script, may be anything but Latin.
_OPEN_WORD = re.compile(rf"(?<![\w{_MARKS}])[{''.join(FORMS)}][{''.join(FORMS)}\d_{_MARKS}]*(?![\w{_MARKS}])")


def script_of(char: str) -> str | None:
    code = ord(char)
    if code < 0x250 or 0x1E00 <= code < 0x1F00:
        return "latin" if char.isalpha() else None
    if 0x370 <= code < 0x400 or 0x1F00 <= code < 0x2000:
        return "greek"
    if 0x400 <= code < 0x530:
        return "cyrillic"
    return "armenian" if 0x530 <= code < 0x590 else None


def visible(text: str) -> str:
    """What is invisible folded away; letters kept as they are. Canonically decomposed."""
    if text.isascii():
        return text
    if _SPECIAL.search(text):
        text = _WIDTH.sub(lambda m: unicodedata.normalize("NFKC", m[0]), text)
        text = _SPACES.sub(" ", _JOINER.sub("", _IGNORED.sub("", text))).translate(_SAME)
    return unicodedata.normalize("NFD", text)


def look(text: str) -> str:
    """A decomposed text with each letter as its class."""
    return text.translate(_LOOK) if _ALIKE.search(text) else text


def resolve(shape: str, scores: dict[tuple[str, str], float]) -> str:
    """Viterbi search through the lattice of a word's shape: letters of one script unless none fits."""
    options = []
    for c in shape:
        forms = FORMS.get(c)
        options.append([(s, forms[s]) for s in SCRIPTS if s in forms] if forms else [(script_of(c), c)])
    fixed = {s for o in options if len(o) == 1 for s, c in o if s is not None and c.isalpha()}
    if len(fixed) == 1:  # letters of one script only: where all classes have a form in it, that path wins without a switch
        (s,) = fixed
        path = [next((c for t, c in o if t in (s, None)), None) for o in options]
        if None not in path:
            return "".join(path)
    best = [(0.0, "", None, "^")]
    for o in options:
        step = []
        for script, c in o:
            found = None
            for score, text, last, before in best:
                value = score + scores.get((before, c), -14.0) + (_SWITCH if script and last and script != last else 0.0)
                if found is None or value > found[0]:
                    found = (value, text + c, script or last, c)
            step.append(found)
        best = step
    return max(best, key=lambda x: x[0])[1]


def canonical(text: str, scores: dict[tuple[str, str], float], known: dict[str, str]) -> str:
    """The consistent form of a text, which follows from its shape alone; known caches resolved words."""
    shape = look(visible(text))
    words = _OPEN_WORD if shape.isascii() or not _OTHER.search(shape) else _WORD
    changed = False
    for word in set(words.findall(shape)):
        found = known.get(word)
        if found is None:
            found = known[word] = resolve(word, scores)
        changed |= found != word
    out = words.sub(lambda m: known[m[0]], shape) if changed else shape
    return out if out.isascii() else unicodedata.normalize("NFC", out)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """Of each code point below U+10000: the bit of its script, 0 what ends a word, 255 what is in words but no letter of SCRIPTS; and a dense number of each such letter, from 1."""
    kind = np.zeros(1 << 16, dtype=np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalnum() or char == "_" or 0x300 <= code < 0x370:
            script = script_of(char) if char.isalpha() else None
            kind[code] = 1 << SCRIPTS.index(script) if script else 255
    letter = (kind > 0) & (kind < 255)
    return kind, np.where(letter, np.cumsum(letter), 0)


KINDS, LETTERS = _kinds()


def letter_pairs(texts: list[str]) -> np.ndarray:
    """Counts of pairs of neighbouring letters in words of a single script, as numbers of LETTERS; 0 is the start of a word."""
    n = int(LETTERS.max()) + 1
    codes = np.minimum(np.frombuffer("\0".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 0xFFFF)
    kind = KINDS[codes]
    word = np.cumsum(kind == 0)
    letter = (kind > 0) & (kind < 255)
    code, word, kind = LETTERS[codes[letter]], word[letter], kind[letter]
    if not len(code):
        return np.zeros((n, n), dtype=np.int64)
    new = np.concatenate(([True], word[1:] != word[:-1]))
    begins = np.flatnonzero(new)
    scripts = np.bitwise_or.reduceat(kind, begins)
    single = np.repeat((scripts & (scripts - 1)) == 0, np.diff(np.concatenate((begins, [len(code)]))))
    before = np.where(new, 0, np.concatenate(([0], code[:-1])))
    return np.bincount((before * n + code)[single], minlength=n * n).reshape(n, n)


def learn(texts: DataFrame) -> dict[tuple[str, str], float]:
    """Log-probabilities of letter pairs inside words, from all texts; at most letters squared rows reach the driver.

    Only words of a single script count, and only letters of the four scripts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, held, size = 0, [], 0
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    held.append(visible(text))
                    size += len(text)
                    if size > 1 << 21:
                        total, held, size = total + letter_pairs(held), [], 0
        total = total + letter_pairs(held)
        a, b = np.nonzero(total)
        yield pd.DataFrame({"a": a, "b": b, "n": total[a, b]})

    rows = texts.select("text").filter("text is not null").mapInPandas(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    char = {int(LETTERS[c]): chr(c) for c in np.flatnonzero(LETTERS)} | {0: "^"}
    totals: Counter = Counter()
    for r in rows:
        totals[r["a"]] += r["n"]
    return {(char[r["a"]], char[r["b"]]): float(np.log((r["n"] + 0.1) / (totals[r["a"]] + 50))) for r in rows}


def restored(texts: DataFrame, scores: dict[tuple[str, str], float]) -> DataFrame:
    """(text) to (script, words, restored): how many words of a single script the search finds again from their looks alone."""
    shared = texts.sparkSession.sparkContext.broadcast(scores)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        good: Counter = Counter()
        known: dict[str, tuple[str, bool]] = {}
        for pdf in batches:
            for text in pdf["text"]:
                for word in _WORD.findall(visible(text)) if text else ():
                    found = known.get(word)
                    if found is None:
                        scripts = {s for s in map(script_of, word) if s}
                        shape = look(word)
                        found = known[word] = (scripts.pop(), resolve(shape, shared.value) == word) if len(scripts) == 1 and any(c in FORMS for c in shape) else ("", False)
                    words[found[0]] += 1
                    good[found[0]] += found[1]
            if len(known) > 500_000:
                known.clear()
        yield pd.DataFrame({"script": list(words), "words": pd.Series(list(words.values()), dtype="int64"), "restored": pd.Series([good[k] for k in words], dtype="int64")})

    rows = texts.select("text").mapInPandas(read, "script string, words long, restored long").filter("script <> ''")
    return rows.groupBy("script").agg(F.sum("words").alias("words"), F.sum("restored").alias("restored"), (F.sum("restored") / F.sum("words")).alias("share"))


def _name(data: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(data, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def normalise(texts: DataFrame, scores: dict[tuple[str, str], float], full: bool = True) -> DataFrame:
    """(id, text) to (id, canonical or its 128-bit name c1 c2, and the name r1 r2 of the text as it is)."""
    shared = texts.sparkSession.sparkContext.broadcast(scores)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, str] = {}
        for pdf in batches:
            out = [None if t is None else canonical(t, shared.value, known) for t in pdf["text"]]
            if len(known) > 500_000:
                known.clear()
            if full:
                yield pd.DataFrame({"id": pdf["id"], "canonical": out})
                continue
            shown = [i for i, x in enumerate(out) if x is not None and not x.isspace() and x]
            c = [_name(out[i].encode("utf-8", "surrogatepass")) for i in shown]
            r = [_name(pdf["text"].iloc[i].encode("utf-8", "surrogatepass")) for i in shown]
            cols = {"c1": [x[0] for x in c], "c2": [x[1] for x in c], "r1": [x[0] for x in r], "r2": [x[1] for x in r]}
            yield pd.DataFrame({"id": pdf["id"].to_numpy()[shown], **{k: pd.Series(v, dtype="int64") for k, v in cols.items()}})

    schema = "id long, canonical string" if full else "id long, c1 long, c2 long, r1 long, r2 long"
    return texts.select("id", "text").mapInPandas(read, schema)
