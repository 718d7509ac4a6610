"""Selection of units: entity cover, vocabulary coverage cut at its knee, or a token budget.

Greedy choice is sequential, so these are kernels over the units of one document; documents run in parallel. ``Table`` has
what a document's choice needs. Ties always go to the lower index.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np

from gistmill import fixed

WORD = re.compile(fixed.WORD)


@dataclass
class Table:
    """Units of a document, column by column."""

    texts: list[str]
    costs: list[int]
    entities: list[frozenset[str]]
    mandatory: list[bool]
    scores: np.ndarray
    headings: list[bool] = field(default_factory=list)

    def words(self, i: int) -> frozenset[str]:
        return frozenset(WORD.findall(self.texts[i].lower()))

    def __len__(self) -> int:
        return len(self.texts)


class OverBudget(Exception):
    """The units that must stay cost more than a hard budget."""

    def __init__(self, requested: int, minimum: int, missing: list[int], kept: list[int]):
        super().__init__(f"TARGET_BUDGET_UNSAFE: requested_tokens={requested}, minimum_safe_tokens={minimum}")
        self.requested, self.minimum, self.missing, self.kept = requested, minimum, missing, kept


def cover(entities: list[frozenset[str]], chosen: set[int], fits=None, take=None) -> set[int]:
    """Units to add so that every entity that can be is held: always the one with most uncovered entities.

    ``fits(i)`` may refuse a unit for now; ``take(i)`` returns what comes with it.
    """
    open_ = frozenset().union(*entities) - frozenset().union(*(entities[i] for i in chosen)) if entities else frozenset()
    holders: dict[str, list[int]] = {}
    for i, own in enumerate(entities):
        if i not in chosen:
            for e in own & open_:
                holders.setdefault(e, []).append(i)
    left = {i: len(entities[i] & open_) for i in sorted({i for own in holders.values() for i in own})}
    added: set[int] = set()
    while True:
        best = max((i for i in left if left[i] and i not in added and (fits is None or fits(i))), key=lambda i: (left[i], -i), default=None)
        if best is None:
            return added
        added |= take(best) if take else {best}
        for e in entities[best]:
            for i in holders.pop(e, ()):
                left[i] -= 1


def curve(table: Table, chosen: set[int]) -> tuple[list[int], list[int], list[int]]:
    """Units in order of new words (weighted by rank) per token, with running tokens and running vocabulary."""
    seen: set[str] = set().union(*(table.words(i) for i in chosen)) if chosen else set()
    cost = [max(1, c) for c in table.costs]
    order, tokens, gained = [], [sum(cost[i] for i in chosen)], [len(seen)]
    words = {i: table.words(i) for i in range(len(table)) if i not in chosen}
    density = lambda i: len(words[i] - seen) * (0.5 + 0.5 * float(table.scores[i])) / cost[i]
    # densities only fall as words are seen, so an entry computed since the last choice and still on top is the best
    queue = [(-d, i, 0) for i in words if (d := density(i)) > fixed.LEAST_DENSITY]
    heapq.heapify(queue)
    while queue:
        _, i, made = heapq.heappop(queue)
        if made == len(order):
            order.append(i)
            seen |= words[i]
            tokens.append(tokens[-1] + cost[i])
            gained.append(len(seen))
        elif (d := density(i)) > fixed.LEAST_DENSITY:
            heapq.heappush(queue, (-d, i, len(order)))
    return order, tokens, gained


def knee(tokens: list[int], gained: list[int]) -> int:
    """How many units to keep of a curve: up to the point farthest above its chord; all of a short or straight one."""
    n = len(tokens) - 1
    across, up = tokens[-1] - tokens[0], gained[-1] - gained[0]
    if n <= 2 or across <= 0 or up <= 0:
        return n
    lift = (np.array(gained, dtype=float) - gained[0]) / up - (np.array(tokens, dtype=float) - tokens[0]) / across
    best = int(np.argmax(lift))
    return best if best > 0 and lift[best] > 0 else n


def select_free(table: Table) -> list[int]:
    """Selection without a budget."""
    if not len(table):
        return []
    chosen = {i for i, m in enumerate(table.mandatory) if m}
    chosen |= cover(table.entities, chosen)
    order, tokens, gained = curve(table, chosen)
    chosen |= set(order[: knee(tokens, gained)])
    return sorted(chosen or {0})


class _Costs:
    """What a unit costs with the headings that closure brings in, and a separator for each unit but the first."""

    def __init__(self, table: Table):
        self.costs = table.costs
        self.above, last = [], None
        for i, h in enumerate(table.headings or [False] * len(table)):
            self.above.append(last)
            last = i if h else last

    def with_headings(self, i: int, have: set[int]) -> set[int]:
        out, at = {i}, self.above[i]
        while at is not None and at not in have and at not in out:
            out.add(at)
            at = self.above[at]
        return out

    def adding(self, i: int, have: set[int]) -> tuple[int, set[int]]:
        if i in have:
            return 0, set()
        new = self.with_headings(i, have)
        return sum(self.costs[j] for j in new) + len(new) - (0 if have else 1), new


def select_within(table: Table, budget: int, hard: bool, count, required_of: list[set[int]]) -> list[int]:
    """Selection within ``budget`` tokens. ``count`` counts a text's tokens; ``required_of`` has each unit's required atoms."""
    if not len(table):
        return []
    price = _Costs(table)
    must: set[int] = set()
    asked = [i for i, m in enumerate(table.mandatory) if m]
    for i in asked:
        must |= price.with_headings(i, must | set(asked))
    must |= set(asked)
    spent = sum(table.costs[i] for i in must) + max(0, len(must) - 1)
    if hard and spent > budget:
        fitted, used = set(), 0
        for i in sorted(must, key=lambda i: (table.costs[i], i)):
            cost, new = price.adding(i, fitted)
            if used + cost <= budget:
                fitted |= new
                used += cost
        held = set().union(*(required_of[i] for i in fitted)) if fitted else set()
        raise OverBudget(budget, spent, sorted(set().union(*(required_of[i] for i in must)) - held), sorted(must))
    have, total = set(must), spent

    def fits(i):
        return i not in have and total + price.adding(i, have)[0] <= budget

    def take(i):
        nonlocal total
        cost, new = price.adding(i, have)
        total += cost
        have.update(new)
        return new

    cover(table.entities, set(must), fits, take)
    for i in sorted(range(len(table)), key=lambda i: (-table.scores[i], i)):
        if fits(i):
            take(i)
    if hard:
        exact = lambda: count("\n".join(table.texts[i] for i in sorted(have)))
        heads = table.headings or [False] * len(table)
        loose = sorted((i for i in have - must if not heads[i]), key=lambda i: (table.scores[i], -table.costs[i], i), reverse=True)
        over = exact() - budget
        while over > 0 and loose:  # drop about as much as is over, then count again
            while over > 0 and loose:
                i = loose.pop()
                have.discard(i)
                over -= table.costs[i] + 1
            over = exact() - budget
    return sorted(have)
