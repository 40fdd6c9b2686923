import itertools

from memlake.functions import extract

SUBJECTS, VALUES = ("Atlas", "the core", "billing-api", "Mara Bo's"), ("to Lisbon.", "80", "5 kg, x", "vegan")


class Watched:
    """A pattern that counts how often it is tried."""

    def __init__(self, pattern):
        self.pattern, self.tried = pattern, 0

    def finditer(self, text):
        self.tried += 1
        return self.pattern.finditer(text)


def test_patterns_are_tried_only_where_their_literals_stand(monkeypatch):
    rules = [(Watched(r), *more) for r, *more in extract.RULES]
    monkeypatch.setattr(extract, "RULES", rules)
    assert extract.facts("Words of no matter here. " * 500 + "Atlas prefers tea.") == [("atlas", "preference", "tea")]
    assert sum(r[0].tried for r in rules) == 1


def test_literals_lose_no_match():
    for rule, attribute, literals in extract.RULES:
        for s, n, v in itertools.product(SUBJECTS, itertools.chain.from_iterable(r[2] for r in extract.RULES), VALUES):
            said = f"{s}{n if n.startswith(' ') else f' is {n}'} {v}".replace("  ", " ")
            assert not rule.search(said) or any(x in said for x in literals), (attribute, said)
