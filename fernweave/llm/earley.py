"""An error-correcting Earley parser of role sequences, and products of its results.

A row is one sign: s, u or a by its role's initial, o for any other, a capital if its text is cut off, x if it must go. The
grammar is left-linear, one nonterminal for each place of a conversation, so every item of a place begins where the parse
began, a column holds a bounded number of items, and a parse is linear in rows:

    B ->             S -> B system        U -> B user | S user | A user        A -> U assistant
    B -> B delete    S -> S delete        U -> U delete                        A -> A delete

B is the beginning, S follows a system row, U a user row, A an assistant row; B and A may be the end. Edits are the
productions with a weight: a role's row is kept (K, 0), another row gets the role (R, 2) or one is inserted (I, 2);
any row is deleted (D, 3). Rows that are kept or get a role cost one more if they are cut off.

An item keeps the least (cost, audit), audits in ASCII order. Of two audits over the same rows with equal cost neither
begins the other, as what one has more would be inserts, which cost; so the lesser stays the lesser whatever follows, and
parses of consecutive stretches, each from every place, combine like a matrix product.
"""

from __future__ import annotations

from functools import lru_cache

PLACES = "BSUA"
ENDS = "BA"
#: (left side, right side, cost, sign of the edit); terminals are sets of row signs.
SYSTEM, USER, ASSISTANT, ROW, ANY = (frozenset(x) for x in ("sS", "uU", "aA", "suaoSUAO", "suaoSUAOx"))
RULES = (
    *((p, (p, "delete"), 0, "") for p in PLACES),
    ("S", ("B", "system"), 0, ""), ("U", ("B", "user"), 0, ""), ("U", ("S", "user"), 0, ""), ("U", ("A", "user"), 0, ""), ("A", ("U", "assistant"), 0, ""),
    ("system", (SYSTEM,), 0, "K"),
    ("user", (USER,), 0, "K"), ("user", (ROW,), 2, "R"), ("user", (), 2, "I"),
    ("assistant", (ASSISTANT,), 0, "K"), ("assistant", (ROW,), 2, "R"), ("assistant", (), 2, "I"),
    ("delete", (ANY,), 3, "D"),
)
OF = {left: [k for k, r in enumerate(RULES) if r[0] == left] for left in {r[0] for r in RULES}}
#: The role that an edit gives a row or an insert at a place, and the place after it.
NEXT = {"B": ("user", "U"), "S": ("user", "U"), "A": ("user", "U"), "U": ("assistant", "A")}

Weight = tuple[int, str]
Table = dict[str, dict[str, Weight]]


class Column:
    """Items of one position: best weight by (rule, dot, origin), those that wait for a symbol, and symbols completed here
    that began here."""

    def __init__(self) -> None:
        self.best: dict[tuple[int, int, int], Weight] = {}
        self.waits: dict[str, list[tuple[int, int, int]]] = {}
        self.empty: dict[str, Weight] = {}


@lru_cache(maxsize=1 << 15)
def parse(rows: str, start: str = "B") -> dict[str, Weight]:
    """For each place that `rows` can lead to from a place: the least cost, and the least audit of that cost."""
    chart = [Column() for _ in range(len(rows) + 1)]
    ends: dict[str, Weight] = {}
    for k, column in enumerate(chart):
        agenda: list[tuple[int, int, int]] = []

        def add(item: tuple[int, int, int], weight: Weight, column=column, agenda=agenda) -> None:
            if item not in column.best or weight < column.best[item]:
                column.best[item] = weight
                agenda.append(item)

        def complete(symbol: str, origin: int, weight: Weight, k=k, column=column, add=add) -> None:
            if origin == k and (symbol not in column.empty or weight < column.empty[symbol]):
                column.empty[symbol] = weight
            if origin == 0 and symbol in PLACES and (symbol not in ends or weight < ends[symbol]):
                ends[symbol] = weight
            for rule, dot, begin in chart[origin].waits.get(symbol, ()):
                cost, audit = chart[origin].best[rule, dot, begin]
                add((rule, dot + 1, begin), (cost + weight[0], audit + weight[1]))

        ends.clear()
        if k == 0:
            for place in PLACES:
                for rule in OF[place]:
                    add((rule, 0, 0), (0, ""))
            complete(start, 0, (0, ""))
        else:  # scan
            sign, before = rows[k - 1], chart[k - 1]
            for (rule, dot, origin), (cost, audit) in before.best.items():
                _, right, weight, edit = RULES[rule]
                if dot < len(right) and isinstance(right[dot], frozenset) and sign in right[dot]:
                    add((rule, dot + 1, origin), (cost + weight + (sign.isupper() and edit != "D"), audit + edit))
        while agenda:
            item = agenda.pop()
            rule, dot, origin = item
            left, right, cost, edit = RULES[rule]
            weight = column.best[item]
            if dot == len(right):
                complete(left, origin, (weight[0] + cost, weight[1] + edit) if not right else weight)
                continue
            symbol = right[dot]
            if isinstance(symbol, frozenset):
                continue
            waiting = column.waits.setdefault(symbol, [])
            if item not in waiting:
                waiting.append(item)
                for r in OF[symbol]:  # predict
                    if (r, 0, k) not in column.best:
                        add((r, 0, k), (0, ""))
            if symbol in column.empty:
                done = column.empty[symbol]
                add((rule, dot + 1, origin), (weight[0] + done[0], weight[1] + done[1]))
    return dict(ends)


def table(rows: str) -> Table:
    """parse() from every place."""
    return {p: parse(rows, p) for p in PLACES}


def then(first: dict[str, Weight], second: Table) -> dict[str, Weight]:
    """What leads to each place over two stretches in a row."""
    out: dict[str, Weight] = {}
    for middle, (cost, audit) in first.items():
        for place, (more, rest) in second[middle].items():
            if place not in out or cost + more <= out[place][0]:
                weight = (cost + more, audit + rest)
                if place not in out or weight < out[place]:
                    out[place] = weight
    return out


class Product:
    """The table of stretches put in one by one; equal sizes are joined first, so that each audit is copied a logarithmic
    number of times."""

    def __init__(self) -> None:
        self.parts: list[tuple[int, Table]] = []

    def put(self, stretch: Table) -> None:
        self.parts.append((1, stretch))
        while len(self.parts) > 1 and self.parts[-2][0] <= self.parts[-1][0]:
            (m, a), (n, b) = self.parts[-2:]
            self.parts[-2:] = [(m + n, {p: then(a[p], b) for p in PLACES})]

    def total(self) -> Table:
        out = {p: {p: (0, "")} for p in PLACES}
        for _, part in self.parts:
            out = {p: then(out[p], part) for p in PLACES}
        return out


def cheapest(ends: dict[str, Weight]) -> Weight:
    """The best of the parses that may end where they do."""
    return min(ends[p] for p in ENDS if p in ends)


class Repair:
    """Follows an audit: edit() takes its signs one by one and says what role comes out, if any."""

    def __init__(self) -> None:
        self.place = "B"

    def edit(self, sign: str, role: str) -> str | None:
        if sign == "D":
            return None
        if sign == "K" and role[:1] == "s":
            self.place = "S"
            return role
        given, self.place = NEXT[self.place]
        return role if sign == "K" else given
