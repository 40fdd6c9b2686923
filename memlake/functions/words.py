"""Words, stems and evidence of one text against another."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Irregular forms and what they come from.
IRREGULAR = {
    "paid": "pay", "bought": "buy", "sold": "sell", "met": "meet", "went": "go", "gone": "go", "ran": "run",
    "taught": "teach", "brought": "bring", "kept": "keep", "lost": "lose", "spent": "spend", "sent": "send",
    "built": "build", "wrote": "write", "written": "write", "chose": "choose", "chosen": "choose",
    "began": "begin", "begun": "begin",
}

# Words that carry no topic of their own.
STOP = frozenset(
    """a about all am an and any are as at be been but by can could did do does for from had has have he her his
    how i if in into is it its me my no not of on or our she should so than that the their them then there these
    they this those to too us was we were what when where which who whom why will with would you your""".split()
)
WORD = re.compile(r"\w+")
CREDIT = 0.8  # for a word met only through its -ing form

# The endings of Porter's algorithm (1980) in its steps 2, 3 and 4 and what stands in their place, and the
# endings that its step 4 takes off.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _sounds(stem: str) -> str:
    """v for each vowel, c for each consonant; a y is a vowel after a consonant."""
    out = ""
    for c in stem:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def _measure(stem: str) -> int:
    return _sounds(stem).count("vc")


def _short(stem: str) -> bool:
    """Whether it ends consonant, vowel, consonant, the last of them not w, x or y."""
    return _sounds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _longest(word: str, endings) -> tuple[str, str] | None:
    """(what is before, the ending) for the longest ending that the word has."""
    found = [e for e in endings if word.endswith(e)]
    return (word[: -len(max(found, key=len))], max(found, key=len)) if found else None


def _plural(word: str) -> str:
    before, ending = _longest(word, ("sses", "ies", "ss", "s")) or (word, "")
    return before + {"sses": "ss", "ies": "i", "ss": "ss"}.get(ending, "")


def _past(word: str) -> str:
    before, ending = _longest(word, ("eed", "ed", "ing")) or (word, "")
    if ending == "eed":
        return before + "ee" if _measure(before) else word
    if not ending or "v" not in _sounds(before):
        return word
    if before.endswith(("at", "bl", "iz")):
        return before + "e"
    if before[-2:-1] == before[-1:] and _sounds(before)[-1] == "c":
        return before if before[-1] in "lsz" else before[:-1]
    return before + "e" if _measure(before) == 1 and _short(before) else before


def _instead(word: str, endings: dict[str, str]) -> str:
    found = _longest(word, endings)
    return found[0] + endings[found[1]] if found and _measure(found[0]) else word


@lru_cache(maxsize=1 << 16)
def stem(word: str) -> str:
    """Porter's stem of a word of ASCII letters, irregular forms first; two letters and other tokens stay."""
    word = IRREGULAR.get(word, word)
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _sounds(word[:-1]):
        word = word[:-1] + "i"
    word = _instead(_instead(word, STEP_2), STEP_3)
    if found := _longest(word, STEP_4):
        before, ending = found
        if _measure(before) > 1 and (ending != "ion" or before[-1] in "st"):
            word = before
    if word.endswith("e") and (_measure(word[:-1]) > 1 or (_measure(word[:-1]) == 1 and not _short(word[:-1]))):
        word = word[:-1]
    return word[:-1] if word.endswith("ll") and _measure(word) > 1 else word


def fold(text: str) -> str:
    """Accents off the letters below U+2000."""
    if text.isascii():
        return text
    apart = unicodedata.normalize("NFKD", text)
    kept = (c for c in apart if not (unicodedata.combining(c) and ord(c) < 0x2000))
    return unicodedata.normalize("NFC", "".join(kept))


def terms(query: str) -> list[str]:
    """Stems of the query's words that carry a topic, in order."""
    words = (w.removesuffix("'s") for w in re.findall(r"\w+(?:'s)?", fold(query).lower()))
    return list(dict.fromkeys(stem(w) for w in words if w not in STOP and (len(w) > 1 or w.isdigit())))


def coverage(query: str, text: str) -> float:
    """Share of the query's terms that the text holds; one met only as another -ing form counts CREDIT."""
    wanted = terms(query)
    if not wanted:
        return 0.0
    said: dict[str, set[bool]] = {}  # of each stem, whether it was met as an -ing form, and whether as another
    for w in WORD.findall(fold(text).lower()):
        for part in {w, *w.split("_")}:
            said.setdefault(stem(part), set()).add(part.endswith("ing"))
    asked = {stem(w): w.endswith("ing") for w in WORD.findall(fold(query).lower())}
    met = [(asked.get(t, False) in said[t]) for t in wanted if t in said]
    return sum(1.0 if same else CREDIT for same in met) / len(wanted)


def fact_key(name: str) -> str:
    """Case, white space, _ and - folded; marks at the edges off, but C, C++ and C# stay apart."""
    return re.sub(r"[\s_\-]+", " ", name.lower()).strip(" .,;:!?\"'()[]")


def anchors(text: str) -> list[str]:
    """Names a text points at: identifiers with digits, _ or inner capitals, and runs of capitalised words."""
    found = re.findall(r"\b(?:[A-Za-z]+(?:[-_][A-Za-z0-9]+)+|[A-Za-z]*\d\w*|[a-z]+[A-Z]\w*|[A-Z]\w*[a-z]\w*[A-Z]\w*)\b", text)
    runs = re.findall(r"(?<![.!?]\s)(?<!^)\b[A-Z]\w+(?:\s+[A-Z]\w+)*", text)
    return list(dict.fromkeys(x for x in [*found, *runs] if x.lower() not in STOP))


def token_estimate(text: str) -> int:
    """Words and marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


# Hiragana, Katakana, Han (with extension A and compatibility) and Hangul.
CJK = "\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7af\u1100-\u11ff\u3130-\u318f"
_PART = re.compile(rf"[{CJK}]+|[^\W{CJK}]+|[^\w\s]")
_IN_CJK = re.compile(rf"[{CJK}]")


def is_symbol(char: str) -> bool:
    """A symbol beyond ASCII (emoji, currency, arrows), but no skin tone or selector."""
    return char > "\x7f" and unicodedata.category(char)[0] == "S" and not "\U0001f3fb" <= char <= "\U0001f3ff"


_RARE = re.compile(rf"[{CJK}]|[^\w\s\x00-\x7f]")


def segment(text: str) -> list[str]:
    """Words; runs of CJK letters as overlapping pairs (one letter alone as it is); symbols as words."""
    if not _RARE.search(text):
        return WORD.findall(text)
    out: list[str] = []
    for part in _PART.findall(text):
        if _IN_CJK.match(part):
            out += [part[i : i + 2] for i in range(len(part) - 1)] or [part]
        elif part[0].isalnum() or part[0] == "_" or is_symbol(part):
            out.append(part)
    return out


_OWNED = re.compile(r"(\w)['’]s\b")
#: Distinct features that a worker remembers the hashes of.
KNOWN_FEATURES = 1 << 19
_hashes: dict[str, int] = {}


def _hash(feature: str) -> int:
    found = _hashes.get(feature)
    if found is None:
        if len(_hashes) >= KNOWN_FEATURES:
            _hashes.clear()
        found = _hashes[feature] = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return found


def embed_all(texts: list[str | None], dim: int = 256) -> np.ndarray:
    """A row for each text: signed feature hashing of words, pairs of words and letter trigrams (half weight), each
    1 + ln of its count, scaled to length 1. A text without words has zeros.

    The words of all texts are numbered first, so trigrams and hashes are found once for each distinct word.
    """
    number: dict[str, int] = {}
    docs = []
    for text in texts:
        said = segment(_OWNED.sub(r"\1", text.lower())) if text else []
        topic = [w for w in said if w not in STOP] or said
        docs.append(np.fromiter((number.setdefault(w, len(number)) for w in topic), np.int64, len(topic)))
    words = list(number)
    trigram: dict[str, int] = {}
    held = [np.fromiter((trigram.setdefault(f"<{w}>"[i : i + 3], len(trigram)) for i in range(len(w))), np.int64, len(w)) for w in words]
    sizes = np.fromiter(map(len, held), np.int64, len(held))
    flat, begin = np.concatenate([np.zeros(0, np.int64), *held]), np.cumsum(sizes) - sizes
    hashed = lambda kind, grams: np.fromiter((_hash(f"{kind}:{g}") for g in grams), np.uint64, len(grams))
    word_hash, trigram_hash = hashed("w", words), hashed("c", trigram)
    out = np.zeros((len(texts), dim))
    for row, own in enumerate(docs):
        if not len(own):
            continue
        code, n = np.unique(own, return_counts=True)
        _add(out[row], word_hash[code], n, 1.0)
        if len(own) > 1:
            pair, m = np.unique(own[:-1] * len(words) + own[1:], return_counts=True)
            _add(out[row], hashed("b", [f"{words[a]} {words[b]}" for a, b in zip(*divmod(pair, len(words)), strict=True)]), m, 1.0)
        size = sizes[code]
        at = np.repeat(begin[code] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        count = np.bincount(flat[at], np.repeat(n, size), 0)
        seen = np.flatnonzero(count)
        _add(out[row], trigram_hash[seen], count[seen], 0.5)
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def _add(vector: np.ndarray, hashes: np.ndarray, counts: np.ndarray, weight: float) -> None:
    size = weight * (1.0 + np.log(counts)) * np.where(hashes >> np.uint64(63), -1.0, 1.0)
    vector += np.bincount((hashes % np.uint64(len(vector))).astype(np.int64), size, len(vector))


def hash_sums(lists: pa.Array, dim: int = 256) -> np.ndarray:
    """A row for each list of words: each word adds 1 or -1 at a place that its MD5 decides, as its third digit is below
    8 or not. A list without words, or null, has zeros."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    digits = [hashlib.md5(w.encode(), usedforsecurity=False).hexdigest() for w in coded.dictionary.to_pylist()]
    at, sign = np.array([int(d[:2], 16) % dim for d in digits], np.int64), np.array([1.0 if d[2] < "8" else -1.0 for d in digits])
    code, row = coded.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(lists)), sizes)
    return np.bincount(row * dim + at[code], sign[code], len(lists) * dim).reshape(len(lists), dim)


def hash_words(lists: pa.Array, dim: int = 256) -> np.ndarray:
    """The root of each of hash_sums, with its sign, scaled to length 1."""
    sums = hash_sums(lists, dim)
    out = np.sign(sums) * np.sqrt(np.abs(sums))
    length = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, length, out=out, where=length > 0)


def sum_cosines(sums: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Cosines of the signed roots of hash_sums, a column for each row of asked, as SQL takes them: products added up and
    divided by both lengths' product. A row's values do not depend on the rows beside it, and the sums are exact but for
    the last rounding, so cosines that are equal come out equal."""
    length, own = np.sqrt(np.abs(sums).sum(axis=1)), np.sqrt(np.abs(asked).sum(axis=1))
    out = np.zeros((len(sums), len(asked)))
    for q, row in enumerate(asked):
        total, lost = np.zeros(len(sums)), np.zeros(len(sums))
        for d in np.flatnonzero(row):
            x = np.sign(row[d]) * np.sqrt(abs(row[d])) * np.sign(sums[:, d]) * np.sqrt(np.abs(sums[:, d]))
            new = total + x
            lost += np.where(np.abs(total) >= np.abs(x), (total - new) + x, (x - new) + total)
            total = new
        by = own[q] * length
        np.divide(total + lost, by, out=out[:, q], where=by > 0)
    return out


def embed(text: str, dim: int = 256) -> list[float]:
    return embed_all([text], dim)[0].tolist()
