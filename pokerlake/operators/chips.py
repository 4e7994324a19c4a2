"""Chips of a hand: what each seat put in, the main and side pots, and who took them.

The plain player table keeps the printed lines: a raise with its total, no blinds or antes,
and only "won (n)" of the summary. These functions follow the chips instead and are used by
``strict=True`` of the parse jobs. ``settled_hand`` works on one hand in plain Python.

* A seat's ledger is a fold over its lines: a call, bet or blind adds its amount, a raise "to
  n" adds n less what the seat has in on that street, a returned bet is taken back, an ante
  counts apart, since it does not count towards a raise.
* Pots are layers of the money between the stakes of the seats that did not fold. A seat that
  is all in with its ante closes a layer of antes; the other antes belong to the first layer
  above. Money of folded seats lies in the layers it reaches.
* "Collected" lines, in the order of the pots, are laid along the pots, end to end, so that a line that
  takes several pots and a pot that several lines share need no rule of their own. What the
  lines do not pay out (rake) is missing from every pot in proportion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADDED = {"call", "bet", "post_sb", "post_bb"}
MOVES = {*ADDED, "raise", "return", "post_ante"}


def settled_hand(seats: list[tuple], events: list[tuple], paid: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Ledger, pots and shares of a hand from its seats, lines and summary amounts (``hand_lines``)."""
    ledger = _ledger(seats, events, paid)
    return ledger, *_pots(ledger, _lines(ledger, events))


def _ledger(seats: list[tuple], events: list[tuple], paid: list[tuple]) -> list[tuple]:
    """A row per seat: seat, name, ante, committed, invested, collected, folded, live.

    ``collected`` sums the seat's "collected" lines; a hand without any takes the amounts of
    the summary. ``live`` seats put chips in and did not fold.
    """
    spent: dict[str, list] = {}  # by name: street, held on it, committed on all streets, ante
    won: dict[str, int] = {}
    folds, lines = set(), False
    for kind, name, amount, _, _, _, _, street in events:
        amount = amount or 0
        if kind == "fold":
            folds.add(name)
        elif kind == "win":
            lines = True
            won[name] = won.get(name, 0) + amount
        elif kind in MOVES:
            state = spent.setdefault(name, ["", 0, 0, 0])
            if state[0] != street:
                state[0], state[1] = street, 0
            if kind == "post_ante":
                state[3] += amount
                continue
            added = amount - state[1] if kind == "raise" else -amount if kind == "return" else amount
            state[1] += added
            state[2] += added
    if not lines:
        for name, amount in paid:
            won[name] = won.get(name, 0) + (amount or 0)
    ledger = []
    for seat, _, name, *_ in seats:
        _, _, committed, ante = spent.get(name, ("", 0, 0, 0))
        folded = name in folds
        ledger.append((seat, name, ante, committed, ante + committed, won.get(name, 0), folded, not folded and ante + committed > 0))
    return ledger


def _stake(s: tuple) -> tuple[int, int]:
    """Where a seat's money ends: 0 and the ante if that is all, else 1 and the chips committed."""
    return (1, s[3]) if s[3] > 0 else (0, s[2])


def _below(s: tuple, cut: tuple[int, int]) -> int:
    """The seat's money up to the cut."""
    return min(s[2], cut[1]) if cut[0] == 0 else s[2] + min(s[3], cut[1])


def _lines(ledger: list[tuple], events: list[tuple]) -> list[tuple[int | None, int]]:
    """Seat and amount of the "collected" lines in the order of the pots; without lines the sums of the seats.

    A seat can only take pots up to its stake, so lines of smaller stakes come first; among equal
    stakes those of side pots come last, whichever way the client prints them. A name without a seat comes first.
    """
    of_name: dict[str, tuple] = {}
    for s in ledger:
        of_name.setdefault(s[1], s)
    found = []
    for kind, name, amount, detail, _, _, nr, _ in events:
        if kind == "win" and amount is not None and amount > 0:
            s = of_name.get(name)
            found.append(((0, -1) if s is None else _stake(s), detail == "side", nr, s and s[0], amount))
    if not found:
        found = [(_stake(s), False, s[0], s[0], s[5]) for s in ledger if s[5] > 0]
    smallest_first = sorted(found, key=lambda x: (x[0], x[1], x[2] is not None, x[2] or 0, x[3] is not None, x[3] or 0, x[4]))
    return [(x[3], x[4]) for x in smallest_first]


def _pots(ledger: list[tuple], wins: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """Pots (pot_no from 1, amount, paid, seats) and shares (pot_no, line_no, seat, amount).

    The last pot also holds what folded seats put in beyond every live stake.
    """
    live = [(_stake(s), s[0]) for s in ledger if s[7]]
    cuts = sorted({stake for stake, _ in live})
    invested, collected = sum(s[4] for s in ledger), sum(amount for _, amount in wins)
    # Money below each cut, rising to everything at the last one.
    tops = [0, *(sum(_below(s, c) for s in ledger) for c in cuts[:-1]), invested]
    ends = [x * collected // max(invested, 1) for x in tops]
    pots, shares = [], []
    for i, cut in enumerate(cuts):
        pots.append((i + 1, tops[i + 1] - tops[i], ends[i + 1] - ends[i], [seat for stake, seat in live if stake >= cut]))
    start = 0
    for i, (seat, amount) in enumerate(wins):
        for j in range(len(cuts)):
            part = min(start + amount, ends[j + 1]) - max(start, ends[j])
            if part > 0:
                shares.append((j + 1, i + 1, seat, part))
        start += amount
    return pots, shares


def build_pots(parsed: DataFrame) -> DataFrame:
    """A row per pot of hands parsed with ``strict=True``: hand_id, pot_no, amount, paid, seats."""
    return parsed.select("hand_id", F.inline("pots"))


def build_pot_shares(parsed: DataFrame) -> DataFrame:
    """What each "collected" line takes of each pot: hand_id, pot_no, line_no, seat, amount."""
    return parsed.select("hand_id", F.inline("shares"))


def _sum(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0).cast("bigint"), lambda total, x: total + of(x))


def money_check(parsed: DataFrame) -> DataFrame:
    """hand_id, invested, collected, rake, total_pot and whether all chips are accounted for."""
    invested, collected = (_sum(F.col("ledger"), lambda s, f=f: s[f]) for f in ("invested", "collected"))
    df = parsed.select("hand_id", invested.alias("invested"), collected.alias("collected"), F.col("rake").cast("bigint").alias("rake"), "total_pot")
    balanced = (F.col("invested") == F.col("total_pot")) & (F.col("invested") == F.col("collected") + F.col("rake"))
    return df.withColumn("balanced", balanced)
