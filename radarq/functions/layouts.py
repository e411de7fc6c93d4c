"""Item layouts of the message categories, as data for the one decoder.

Each category lists its items in the order of their presence bits (FRN). A layout says how long an
item is: ("F", n) fixed; ("X",) bytes that go on while bit 0 is set; ("R", n) a count byte and so many
times n bytes; ("L",) a length byte that counts itself; ("C", sizes) presence bytes, then sub-items of
these sizes (negative: repeated, a count byte and so many times that). "-" is a spare bit.
All of these are fixed values of the public format.
"""

from __future__ import annotations

from dataclasses import dataclass

X, L = ("X",), ("L",)


def fixed(n: int) -> tuple:
    return ("F", n)


def repeated(n: int) -> tuple:
    return ("R", n)


def compound(*sizes: int) -> tuple:
    return ("C", sizes)


SPARE = ("-", fixed(0))


@dataclass(frozen=True)
class Layout:
    items: tuple[tuple[str, tuple], ...]
    only_first: bool = False  # of a block, the first record alone is read

    def number(self, item: str) -> int:
        """Zero-based place of an item."""
        return next(i for i, (name, _) in enumerate(self.items) if name == item)


LAYOUTS: dict[int, Layout] = {
    1: Layout((
        ("010", fixed(2)), ("020", X), ("040", fixed(4)), ("070", fixed(2)), ("090", fixed(2)), ("130", X), ("141", fixed(2)),
        ("050", fixed(2)), ("120", fixed(1)), ("131", fixed(1)), ("080", fixed(2)), ("100", fixed(4)), ("060", fixed(2)), ("030", X),
        ("150", fixed(1)), SPARE, SPARE, SPARE, SPARE, ("SP", L), ("RE", L),
    )),
    2: Layout((
        ("010", fixed(2)), ("000", fixed(1)), ("020", fixed(1)), ("030", fixed(3)), ("041", fixed(2)), ("050", X), ("060", X),
        ("070", repeated(2)), ("100", fixed(8)), ("090", fixed(2)), ("080", X), SPARE, ("SP", L), ("RE", L),
    ), only_first=True),
    8: Layout((
        ("010", fixed(2)), ("000", fixed(1)), ("020", X), ("036", repeated(3)), ("034", repeated(4)), ("040", fixed(2)), ("038", repeated(4)),
        ("090", fixed(3)), ("100", X), ("110", X), ("120", fixed(2)), SPARE, ("SP", L), ("RE", L),
    )),
    10: Layout((
        ("010", fixed(2)), ("000", fixed(1)), ("020", X), ("140", fixed(3)), ("041", fixed(8)), ("040", fixed(4)), ("042", fixed(4)),
        ("200", fixed(4)), ("202", fixed(4)), ("161", fixed(2)), ("170", X), ("060", fixed(2)), ("220", fixed(3)), ("245", fixed(7)),
        ("250", repeated(8)), ("300", fixed(1)), ("090", fixed(2)), ("091", fixed(2)), ("270", X), ("550", fixed(1)), ("310", fixed(1)),
        ("500", fixed(4)), ("280", repeated(2)), ("131", fixed(1)), ("210", fixed(2)), SPARE, ("SP", L), ("RE", L),
    )),
    19: Layout((("010", fixed(2)), ("000", fixed(1)), ("140", fixed(3)), ("550", fixed(1)), ("551", fixed(1)), ("552", repeated(2)), ("553", X), ("600", fixed(8)), ("610", fixed(2)), ("620", fixed(1)), SPARE, SPARE, ("RE", L), ("SP", L)), only_first=True),
    20: Layout((
        ("010", fixed(2)), ("020", X), ("140", fixed(3)), ("041", fixed(8)), ("042", fixed(6)), ("161", fixed(2)), ("170", X),
        ("070", fixed(2)), ("202", fixed(4)), ("090", fixed(2)), ("100", fixed(4)), ("220", fixed(3)), ("245", fixed(7)), ("110", fixed(2)),
        ("105", fixed(2)), ("210", fixed(2)), ("300", fixed(1)), ("310", fixed(1)), ("500", compound(6, 6, 2)), ("400", repeated(1)), ("250", repeated(8)),
        ("230", fixed(2)), ("260", fixed(7)), ("030", X), ("055", fixed(1)), ("050", fixed(2)), ("RE", L), ("SP", L),
    )),
    21: Layout((
        ("010", fixed(2)), ("040", fixed(2)), ("030", fixed(3)), ("130", fixed(8)), ("080", fixed(3)), ("140", fixed(2)), ("090", fixed(2)),
        ("210", fixed(1)), ("230", fixed(2)), ("145", fixed(2)), ("150", fixed(2)), ("151", fixed(2)), ("152", fixed(2)), ("155", fixed(2)),
        ("157", fixed(2)), ("160", fixed(4)), ("165", X), ("170", fixed(6)), ("095", fixed(1)), ("032", fixed(1)), ("200", fixed(1)),
        ("020", fixed(1)), ("220", compound(2, 2, 2, 1)), ("146", fixed(2)), ("148", fixed(2)), ("110", compound(2, -15)), ("070", fixed(2)), ("131", fixed(1)),
        SPARE, SPARE, SPARE, SPARE, SPARE, ("RE", L), ("SP", L),
    )),
    34: Layout((
        ("010", fixed(2)), ("000", fixed(1)), ("030", fixed(3)), ("020", fixed(1)), ("041", fixed(2)), ("050", compound(1, 0, 0, 1, 1, 2)), ("060", compound(1, 0, 0, 1, 1, 1)),
        ("070", repeated(2)), ("100", fixed(8)), ("110", fixed(1)), ("120", fixed(8)), ("090", fixed(2)), ("RE", L), ("SP", L),
    ), only_first=True),
    48: Layout((
        ("010", fixed(2)), ("140", fixed(3)), ("020", X), ("040", fixed(4)), ("070", fixed(2)), ("090", fixed(2)), ("130", compound(1, 1, 1, 1, 1, 1, 1)),
        ("220", fixed(3)), ("240", fixed(6)), ("250", repeated(8)), ("161", fixed(2)), ("042", fixed(4)), ("200", fixed(4)), ("170", X),
        ("210", fixed(4)), ("030", X), ("080", fixed(2)), ("100", fixed(4)), ("110", fixed(2)), ("120", compound(2, -6)), ("230", fixed(2)),
        ("260", fixed(7)), ("055", fixed(1)), ("050", fixed(2)), ("065", fixed(1)), ("060", fixed(2)), ("SP", L), ("RE", L),
    )),
}
