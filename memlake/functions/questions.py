"""What a question asks for: how deep, about when, of which kind; and what a statement replaces.

All of it reads a text as lower-case words and looks them up in small sets.
"""

from __future__ import annotations

import datetime
import math
import re

from memlake.functions.dates import DAYS, MONTHS, find_dates
from memlake.functions.words import STOP, WORD, anchors, fold, stem

ANY_DAY = datetime.date(2026, 1, 1)
_READ = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*|[,;:.?!]")


def read(text: str) -> list[str]:
    """Lower-case words, inner hyphens and apostrophes kept, and the marks that end a clause."""
    return [w.replace("’", "'") for w in _READ.findall(text.lower())]


def without_dates(text: str, reference: datetime.date = ANY_DAY, keep: frozenset[str] = frozenset()) -> str:
    """The text with blanks in place of its date expressions, but for those in keep."""
    for _, _, found, at in reversed(find_dates(text, reference)):
        if found.lower() not in keep:
            text = text[:at] + " " + text[at + len(found) :]
    return text


def stems_of(words: str) -> frozenset[str]:
    return frozenset(map(stem, words.split()))


# Signs of a question's shape, as stems, and how much each weighs. A question with a weight of w has
# the complexity 1 - exp(-w), so each further sign adds less.
SIGNS = {
    "reasoning": (0.35, stems_of("why how explain explanation reason justify rationale analyze analyse analysis evaluate assess interpret motive purpose describe summarize summarise")),
    "comparison": (0.35, stems_of("compare comparison contrast versus vs differ difference similar similarity alike unlike better worse tradeoff advantage prefer")),
    "multi_hop": (0.45, stems_of("then because therefore thereby hence thus consequently subsequently afterwards eventually led lead cause caused result resulted affected")),
    "temporal": (0.2, stems_of("when before after since until recently earlier later ago previously formerly now currently")),
    "negation": (0.15, stems_of("not no never none nobody nothing without neither nor cannot except unless")),
}
PATH_STEPS = ("step by step", "in detail", "one after another")
LOOKUP = {"what", "who", "which", "where", "when"}
COMMAND = {"define", "list", "name", "show", "give"}
BE = {"is", "are", "was", "were", "did", "does", "do"}
CLASSES = "struct<complexity:double,policy:string,factual:boolean,multi_hop:boolean,temporal:boolean,comparison:boolean,multi_entity:boolean,reasoning:boolean,negation:boolean,depth:int,keywords:array<string>>"


def classify(query: str) -> dict:
    """Complexity from 0 to 1, the policy it leads to, and the signs it rests on."""
    said = read(query)
    words = [w for w in said if w[0].isalnum()]
    stems = {stem(w) for w in words}
    sign = {name: bool(stems & found) for name, (_, found) in SIGNS.items()}
    sign["negation"] |= any(w.endswith("n't") for w in words)
    sign["temporal"] |= bool(find_dates(query, ANY_DAY))
    named = {w for w in re.findall(r"(?<=[\w,;:] )[A-Z]\w+", query) if w.lower() not in STOP}
    sign["multi_entity"] = len(named) > 1
    factual = bool(words) and (words[0] in COMMAND or (words[0] in LOOKUP and len(words) > 1 and (words[1].partition("'")[0] in BE)) or words[0].partition("'")[0] in LOOKUP and "'" in words[0])
    weight = sum(w for name, (w, _) in SIGNS.items() if sign[name]) + 0.25 * sign["multi_entity"] + len(words) / 40
    weight += 0.1 * sum(w in ",;" for w in said) + 0.3 * any(p in query.lower() for p in PATH_STEPS) - 0.3 * (factual and not sign["reasoning"])
    complexity = round(1 - math.exp(-max(weight, 0.0)), 4)
    layers = sum(sign[s] for s in ("reasoning", "comparison", "multi_hop", "temporal"))
    return {
        "complexity": complexity, "policy": "fast" if complexity < 0.3 else "balanced" if complexity < 0.6 else "deep", "factual": factual, **sign,
        "depth": 1 + min(layers, 2), "keywords": list(dict.fromkeys(w for w in words if len(w) > 2 and w not in STOP)),
    }


# A question is about the present or the beginning by an adverb, or by an adjective that stands before its noun and after
# what may open a noun phrase. After a noun the same word is a noun itself ("peak current"); some pairs are one word.
TIMES = {
    "current": {"adverb": frozenset("now nowadays currently presently today still recently lately".split()), "adjective": frozenset("current present latest newest recent last".split())},
    "original": {"adverb": frozenset("originally initially formerly previously beforehand".split()), "adjective": frozenset("original initial first earliest oldest former previous".split())},
}
OPENS = frozenset("the my our your his her its their this that these those whose which what a an very of in on at by for from with as to and or is are was were s".split())
ONE_WORD = frozenset({("first", "name"), ("first", "aid"), ("first", "class"), ("first", "person"), ("first", "floor"), ("last", "name"), ("last", "resort"), ("last", "minute"), ("present", "perfect"), ("current", "affairs"), ("current", "account")})
SUBJECTS = frozenset("i you he she it we they who what which there".split())


def time_asked(query: str, reference: str = "2026-01-01") -> str:
    """current, original or none; dates are ranges and "first name" is no time, and the present wins."""
    adverbs = TIMES["current"]["adverb"] | TIMES["original"]["adverb"]
    words = read(without_dates(query, datetime.date.fromisoformat(reference), adverbs))

    def phrase(i: int) -> bool:
        """An adjective of time at i qualifies the noun behind it."""
        after = words[i + 1] if i + 1 < len(words) else ""
        opened = i == 0 or words[i - 1] in OPENS or words[i - 1].endswith("'s") or not words[i - 1][0].isalnum()
        return opened and after[:1].isalpha() and after not in STOP and (words[i], after) not in ONE_WORD

    for asked, signs in TIMES.items():
        if any(w in signs["adverb"] or (w in signs["adjective"] and phrase(i)) for i, w in enumerate(words)):
            return asked
    pairs = list(zip(words, words[1:], strict=False))
    if ("any", "more") in pairs or "anymore" in words or ("these", "days") in pairs:
        return "current"
    habit = any(a == "used" and b == "to" and i and (words[i - 1] in SUBJECTS or words[i - 1] not in STOP) for i, (a, b) in enumerate(pairs))
    closing = any(w == "before" and (i + 1 == len(words) or not words[i + 1][0].isalnum()) for i, w in enumerate(words))
    return "original" if habit or closing or ("at", "first") in pairs else "none"


# Words for kinds of memories.
KIND_WORDS = {"todo": "todo", "to-do": "todo", "task": "todo", "bug": "bug", "decision": "decision", "fix": "fix", "snippet": "snippet", "preference": "preference"}
OPEN = frozenset("open unresolved outstanding pending remaining left unfinished undone".split())
ENDED = frozenset("done fixed resolved closed finished".split())
LISTING = frozenset("what which list show display tell give".split())


def kind_asked(query: str) -> tuple[str, bool] | None:
    """(kind, only open ones) that a listing question asks for."""
    words = [w for w in read(query.lower().replace("action item", "task")) if w[0].isalnum()]
    at = next((i for i, w in enumerate(words) if _kind(w)), None)
    if at is None:
        return None
    kind = _kind(words[at])
    near = words[max(at - 1, 0) : at] + words[at + 1 : at + 5]
    rest = [w for i, w in enumerate(words) if i != at and w not in STOP and w not in LISTING and w not in ("still", "all")]
    if OPEN & set(near) or any(a == "not" and b in ENDED for a, b in zip(near, near[1:], strict=False)):
        return kind, True
    return (kind, False) if words[0] in LISTING and not rest else None


def _kind(word: str) -> str | None:
    return next((KIND_WORDS[w] for w in (word, word.removesuffix("s"), word.removesuffix("es")) if w in KIND_WORDS), None)


CHANGING = stems_of("move switch migrate change replace rename upgrade downgrade update correct correction supersede deprecate remove retire revert relocate swap resolve reassign")
CHANGED_TO = (("no", "longer"), ("any", "more"), ("used", "to"))
STATED = frozenset("now nowadays instead actually anymore".split())
HEADED = frozenset("done fixed resolved update correction".split())


def changes(text: str) -> bool:
    """Whether a statement says that something is not as it was."""
    words = read(text)
    pairs = list(zip(words, words[1:], strict=False))
    return any(w in STATED or stem(w) in CHANGING for w in words) or any(p in CHANGED_TO or (p[0] in HEADED and p[1] == ":") for p in pairs)


# What stands before a value that is gone, and what must stand behind it (nothing: the clause ends).
BEFORE_OLD = {("from",): ("to", "into"), ("instead", "of"): (), ("rather", "than"): (), ("no", "longer"): (), ("used", "to"): (), ("replaced",): (), ("replaces",): (), ("replacing",): (), ("not",): ()}
CLAUSE = frozenset(",;:.?!") | {"but", "and", "any", "because", "with", "since", "anymore"}
LONGEST_VALUE = 6


def replaced(text: str) -> list[str]:
    """Values that a statement says were replaced."""
    words, out = read(text), []
    for i in range(len(words)):
        for opening, closing in BEFORE_OLD.items():
            if tuple(words[i : i + len(opening)]) == opening:
                rest = words[i + len(opening) :]
                end = next((k for k, w in enumerate(rest) if w in CLAUSE or w in closing), len(rest))
                closed = not closing or (end < len(rest) and rest[end] in closing)
                if closed and 0 < end <= LONGEST_VALUE:
                    out.append(normal(" ".join(rest[:end])))
    return [v for v in dict.fromkeys(out) if len(v) > 1]


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower().replace("_", " ")))


def topic(text: str) -> frozenset[str]:
    """Stems of what a statement is about, without dates and words of change."""
    said = set(WORD.findall(fold(without_dates(text)).lower()))
    return frozenset(stem(w) for w in said - STOP - STATED - HEADED if len(w) > 1) - CHANGING - {"longer"}


def names(text: str) -> frozenset[str]:
    """The names a statement points at; days and months are none."""
    return frozenset(normal(a) for a in anchors(text)) - DAYS.keys() - MONTHS.keys() - HEADED


#: Shared stems, and their share of the shorter topic, from which two statements are about the same.
SAME_TOPIC, SAME_SHARE = 2, 0.4


def supersedes(new: str, old: str) -> bool:
    """Whether the newer text reads as an update of the older: it is worded as a change, names no other subject,
    and either replaces a value that the old one has or is about the same thing, not only the same name."""
    if not changes(new):
        return False
    own, other = names(new), names(old)
    if own and other and own.isdisjoint(other):
        return False
    if any(f" {v} " in f" {normal(old)} " for v in replaced(new)):
        return True
    shared, shorter = topic(new) & topic(old), min(len(topic(new)), len(topic(old)))
    of_names = {stem(w) for n in own | other for w in n.split()}
    return len(shared) >= max(SAME_TOPIC, SAME_SHARE * shorter) and not shared <= of_names
