"""Facts stated in text as (subject, attribute, value) rows, by a table of rules."""

from __future__ import annotations

import json
import re

from memlake.functions.words import fact_key

S, V = r"(?P<s>[A-Z][\w.-]*(?: [A-Z][\w.-]*)*|[tT]he [\w-]+(?: [\w-]+)?|[a-z][\w]*-[\w-]+)", r"(?P<v>[^.,;]+?)"
END = r"(?=\s*(?:[.,;]|\band\b|$))"
# Own rules: wording, the attribute it states, and literals of which any match holds one: without them the pattern is not tried.
RULES: list[tuple[re.Pattern, str, tuple[str, ...]]] = [
    (re.compile(p), a, n)
    for p, a, n in [
        (rf"\b{S} (?:moved|switched|migrated|changed) (?:from [^.,;]+? )?to {V}{END}", "uses", (" moved ", " switched ", " migrated ", " changed ")),
        (rf"\b{S} is owned by {V}{END}", "owner", (" is owned by ",)),
        (rf"\b{V} owns {S}{END}", "owner", (" owns ",)),
        (rf"\b{S} (?:listens|runs) on port (?P<v>\d+)", "port", (" on port ",)),
        (rf"\b{S} (?:runs|is deployed|is hosted) (?:on|in) {V}{END}", "placement", (" runs ", " is deployed ", " is hosted ")),
        (rf"\b{S} (?:is based|lives) in {V}{END}", "location", (" is based in ", " lives in ")),
        (rf"\b{S} reports to {V}{END}", "manager", (" reports to ",)),
        (rf"\b{S} (?:works at|works for|joined) {V}{END}", "employer", (" works at ", " works for ", " joined ")),
        (rf"\b{S}(?:'s)? status (?:is|changed to) {V}{END}", "status", (" status ",)),
        (rf"\b{S} is assigned to {V}{END}", "assignee", (" is assigned to ",)),
        # People.
        (rf"\b{S} works as an? {V}{END}", "occupation", (" works as a",)),
        (rf"\b{S} is (?P<v>\d{{1,3}}) years old", "age", (" years old",)),
        (rf"\b{S} was born (?:on|in) {V}{END}", "birth", (" was born ",)),
        (rf"\b{S} is married to {V}{END}", "spouse", (" is married to ",)),
        (rf"\b{S} is allergic to {V}{END}", "allergy", (" is allergic to ",)),
        (rf"\b{S} is (?:an? )?(?P<v>vegetarian|vegan|pescatarian)\b", "diet", ("vegetarian", "vegan", "pescatarian")),
        (rf"\b{S} (?:started|begins|began) (?:work|working) (?:on|in) {V}{END}", "job start", (" started work", " begins work", " began work")),
        (rf"\b{S} prefers {V}{END}", "preference", (" prefers ",)),
        (rf"\b{S} speaks (?P<v>[^.;]+?)(?=\s*(?:[.;]|$))", "language", (" speaks ",)),
        # Things and plans.
        (rf"\b{S} costs (?P<v>[$€£]?\d+(?:[.,]\d+)*(?: (?:dollars|euros|pounds))?)", "price", (" costs ",)),
        (rf"\b{S} (?:weighs|measures) (?P<v>\d+(?:[.,]\d+)* ?[a-z]+)", "measure", (" weighs ", " measures ")),
        (rf"\b{S} drinks {V}{END}", "drink", (" drinks ",)),
        (rf"\b{S} uses {V}{END}", "uses", (" uses ",)),
        (rf"\b{S} works on {V}{END}", "project", (" works on ",)),
        (rf"\b{S} has an appointment (?:on|at|with) {V}{END}", "appointment", (" has an appointment ",)),
    ]
]
#: Attributes whose value is a list.
LISTED = frozenset(("language",))
#: Own names for the same attribute.
SAME = {"boss": "manager", "lead": "manager", "job": "occupation", "profession": "occupation", "birthday": "birth", "date of birth": "birth", "mail": "email", "e mail": "email", "telephone": "phone", "city": "location", "home town": "location", "company": "employer"}
ENV = re.compile(r"^\s*(?:export\s+)?(?P<a>[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+)=(?P<v>\S.*?)\s*$")
LIST = re.compile(r"^\s*(?P<a>emails?|phones?|languages?|members?|owners?)\s*(?:of|for) (?P<s>[\w .-]+?)\s*:\s*(?P<v>\S.*?)\s*$", re.I)
COMMA = re.compile(r"\s*(?:,|;|\band\b)\s*")
OF = re.compile(rf"\b[Tt]he (?P<a>[a-z]+) (?:of|for) {S} is (?:now )?{V}{END}")
HAS = re.compile(rf"\b{S}'s (?P<a>[a-z]+) is (?:now )?{V}{END}")
PAIR = re.compile(r"^\s*(?P<s>[A-Za-z][\w-]*)[. ](?P<a>[A-Za-z][\w-]*)\s*[:=]\s*(?P<v>\S.*?)\s*$")
NEGATED = re.compile(r"\b(?:not|never|no longer|used to)\b", re.I)
PRONOUNS = frozenset(("it", "this", "that", "he", "she", "they", "we", "i", "you"))


def _row(s: str, a: str, v: str) -> tuple[str, str, str] | None:
    """The row as it is kept, or nothing: pronouns are no subjects, and masked values none to keep."""
    s, v = re.sub(r"^[Tt]he ", "", s.strip()), re.sub(r"^(?:the|a|an) ", "", v.strip())
    if not s or not v or s.lower() in PRONOUNS or v.lower() in PRONOUNS or v.startswith("[REDACTED"):
        return None
    a = fact_key(a)
    return fact_key(s), SAME.get(a, a), v


def facts(text: str) -> list[tuple[str, str, str]]:
    """What the text states, in order and each once; negated sentences state nothing."""
    out: list[tuple[str, str, str] | None] = []
    record = None
    if text.lstrip().startswith("{"):
        try:
            record = json.loads(text)
        except ValueError:
            pass
    if isinstance(record, dict) and (name := record.get("name") or record.get("id")):
        out += [_row(str(name), str(k), v if isinstance(v, str) else json.dumps(v)) for k, v in record.items() if k not in ("name", "id")]
        return list(dict.fromkeys(r for r in out if r))
    table: list[str] | None = None
    rules = [r for r in RULES if any(n in text for n in r[2])]
    if not rules and not any(n in text for n in (" is ", "|", "=", ":")):
        return []
    for line in text.split("\n"):
        if line.count("|") >= 2:
            cells = [c.strip() for c in line.strip().strip("|").split("|")]
            if table is None:
                table = cells
            elif not all(re.fullmatch(r":?-+:?", c) for c in cells):
                out += [_row(cells[0], a, v) for a, v in zip(table[1:], cells[1:], strict=False)]
            continue
        table = None
        if "=" in line and (m := ENV.match(line)):
            out.append(_row("environment", m["a"], m["v"]))
            continue
        if ":" in line and (m := LIST.match(line)):
            out += [_row(m["s"], m["a"].lower().removesuffix("s"), v) for v in COMMA.split(m["v"])]
            continue
        if (":" in line or "=" in line) and (m := PAIR.match(line)):
            out.append(_row(m["s"], m["a"], m["v"]))
            continue
        own, named = [r for r in rules if any(n in line for n in r[2])], " is " in line
        if not own and not named:
            continue
        for sentence in re.split(r"(?<=[.!?])\s+", line):
            told, named = [r for r in own if any(n in sentence for n in r[2])], " is " in sentence
            if not told and not named or NEGATED.search(sentence):
                continue
            for m in (*OF.finditer(sentence), *HAS.finditer(sentence)) if named else ():
                out.append(_row(m["s"], m["a"], m["v"]))
            for rule, attribute, _ in told:
                out += [_row(m["s"], attribute, v) for m in rule.finditer(sentence) for v in (COMMA.split(m["v"]) if attribute in LISTED else [m["v"]])]
    return list(dict.fromkeys(r for r in out if r))


# Own rules for what a user says of themselves, and for what holds no more or held before.
SELF: list[tuple[re.Pattern, str]] = [
    (re.compile(p, re.I), a)
    for p, a in [
        (rf"\bI (?:live|am based|'m based) in {V}{END}", "location"),
        (rf"\bI (?:work|am working|'m working) (?:at|for) {V}{END}", "employer"),
        (rf"\bI(?: am|'m) allergic to {V}{END}", "allergy"),
        (rf"\bI (?:like|love|prefer|enjoy) {V}{END}", "likes"),
        (rf"\bI (?:dislike|hate|can't stand) {V}{END}", "dislikes"),
        (rf"\bI (?:use|am using|'m using) {V}{END}", "uses"),
        (rf"\bmy name is {V}{END}", "name"),
    ]
]
MINE = re.compile(rf"\b[Mm]y (?P<a>[a-z]+(?: [a-z]+)?) is (?:now )?{V}{END}")
OPPOSITE = {"likes": "dislikes", "dislikes": "likes"}
STOPPED: list[tuple[re.Pattern, str, str]] = [
    (re.compile(p), op, a)
    for p, op, a in [
        (rf"\b{S} (?:no longer|doesn't|does not) uses? {V}(?: any ?more)?{END}", "retract", "uses"),
        (rf"\b{S} stopped using {V}{END}", "retract", "uses"),
        (rf"\b{S} is no longer owned by {V}{END}", "retract", "owner"),
        (rf"\b{S} used to (?:be owned by|belong to) {V}{END}", "previous", "owner"),
        (rf"\b{S} used to (?:use|run on) {V}{END}", "previous", "uses"),
        (rf"\b{S} (?:moved|switched|migrated) from {V} to\b", "previous", "uses"),
    ]
]
STOPPED_SELF: list[tuple[re.Pattern, str, str]] = [
    (re.compile(p, re.I), op, a)
    for p, op, a in [
        (rf"\bI (?:no longer|don't) live in {V}(?: any ?more)?{END}", "retract", "location"),
        (rf"\bI used to live in {V}{END}", "previous", "location"),
        (rf"\bI (?:no longer|don't) work (?:at|for) {V}(?: any ?more)?{END}", "retract", "employer"),
        (rf"\bI used to work (?:at|for) {V}{END}", "previous", "employer"),
    ]
]


def statements(text: str) -> list[tuple[str, str, str, str]]:
    """(op, subject, attribute, value): add for what holds, retract for what holds no more, previous for what held before.
    First persons are the subject user; liking what was disliked retracts the dislike."""
    out = [("add", *r) for r in facts(text)]
    for sentence in re.split(r"(?<=[.!?])\s+|\n", text):
        for rule, op, a in STOPPED:
            out += [(op, *r) for m in rule.finditer(sentence) if (r := _row(m["s"], a, m["v"]))]
        for rule, op, a in STOPPED_SELF:
            out += [(op, *r) for m in rule.finditer(sentence) if (r := _row("user", a, m["v"]))]
        if NEGATED.search(sentence):
            continue
        for rule, a in SELF:
            for m in rule.finditer(sentence):
                if r := _row("user", a, m["v"]):
                    out.append(("add", *r))
                    if a in OPPOSITE:
                        out.append(("retract", r[0], OPPOSITE[a], r[2]))
        for m in MINE.finditer(sentence):
            if m["a"] != "name" and (r := _row("user", m["a"], m["v"])):
                out.append(("add", *r))
    return list(dict.fromkeys(out))
