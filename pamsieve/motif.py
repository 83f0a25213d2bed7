"""Motifs: where a guide lies next to its PAM, and the IUPAC alphabet."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

#: Each IUPAC letter's bases as a mask of A=1, C=2, G=4, T=8; a gap is compatible with nothing.
MASKS = {
    "A": 1, "C": 2, "G": 4, "T": 8, "M": 3, "R": 5, "W": 9, "S": 6, "Y": 10, "K": 12,
    "V": 7, "H": 11, "D": 13, "B": 14, "N": 15, "-": 0,
}
LETTERS = {mask: letter for letter, mask in MASKS.items()}
COMPLEMENT_FROM = "ACGTRYKMBVDHSWN-"
COMPLEMENT_TO = "TGCAYRMKVBHDSWN-"
_COMPLEMENT = str.maketrans(COMPLEMENT_FROM, COMPLEMENT_TO)


def complement(s: str) -> str:
    return s.translate(_COMPLEMENT)


def reverse_complement(s: str) -> str:
    return complement(s)[::-1]


def combine(a: str, b: str, blank: str = "X") -> str:
    """Merge two patterns of one length; exactly one of them holds a letter at each place."""
    if len(a) != len(b):
        raise ValueError("guide and PAM patterns must have the same length")
    out = []
    for x, y in zip(a, b, strict=True):
        if (x == blank) == (y == blank):
            raise ValueError("each place must belong to the guide or to the PAM")
        out.append(y if x == blank else x)
    return "".join(out)


@dataclass(frozen=True)
class Motif:
    """A guide pattern and its PAM, both of the motif's length, with X where the other one stands.

    ``extends5``: the PAM is at the 3' end and sites are extended at the 5' end; else the other way round.
    """

    alias: str
    guide_pattern: str
    pam_pattern: str
    forward: bool = True
    reverse: bool = True
    distance: int = 4
    extends5: bool = True
    ambig_max: int = 0

    def __post_init__(self) -> None:
        merged = combine(self.guide_pattern, self.pam_pattern)
        if bad := set(merged) - set(MASKS) | ({"-"} & set(merged)):
            raise ValueError(f"not IUPAC letters: {sorted(bad)}")
        if self.distance < 0 or self.ambig_max < 0:
            raise ValueError("distance and ambig_max can't be negative")
        if len(re.findall("[^X]+", self.pam_pattern)) != 1:
            raise ValueError("the PAM must be one run of letters")
        start = re.search("[^X]+", self.pam_pattern).start()
        if start not in (0, len(self.guide_pattern) - len(self.pam)):
            raise ValueError("the PAM must be at one end")
        if (start == 0) == self.extends5 and self.length_no_pam:
            raise ValueError("sites are extended on the side away from the PAM")

    @property
    def fwd(self) -> str:
        return combine(self.guide_pattern, self.pam_pattern) if self.forward else ""

    @property
    def rve(self) -> str:
        return reverse_complement(combine(self.guide_pattern, self.pam_pattern)) if self.reverse else ""

    @property
    def pam(self) -> str:
        return self.pam_pattern.replace("X", "")

    @property
    def length_no_pam(self) -> int:
        return len(self.guide_pattern) - len(self.pam)

    def __len__(self) -> int:
        return len(self.guide_pattern)

    def same(self, other: Motif) -> bool:
        """Equal but for the alias."""
        return replace(self, alias="") == replace(other, alias="")

    def with_distance(self, distance: int) -> Motif:
        return replace(self, distance=distance)

    def with_ambig(self, ambig_max: int) -> Motif:
        return replace(self, ambig_max=ambig_max)

    def orient(self, guide: str) -> str:
        """The guide as sites are written: the letter next to the PAM first."""
        return guide[::-1] if self.extends5 else guide

    def append_pam(self, guide: str) -> str:
        return guide + self.pam if self.extends5 else self.pam + guide

    def describe(self) -> str:
        side = "5'" if self.extends5 else "3'"
        return f"{self.alias}: {self.fwd or '-'} / {self.rve or '-'}, PAM {self.pam}, up to {self.distance} edits, extended at {side}, {self.ambig_max} ambiguous"

    def check_guides(self, guides: list[str], distance: int, concrete: bool = False) -> None:
        """Raise ValueError for guides or a distance that a search can't take."""
        if not 0 <= distance <= self.distance:
            raise ValueError(f"distance must lie between 0 and {self.distance}")
        for g in guides:
            if len(g) != self.length_no_pam:
                raise ValueError(f"guide {g} must have {self.length_no_pam} letters")
            if set(g) - (set("ACGT") if concrete else set(MASKS) - {"-"}):
                raise ValueError(f"guide {g} has letters that can't be searched")


def _preset(alias: str, length: int, pam: str, distance: int = 4, pam_first: bool = False) -> Motif:
    blank, n = "X" * len(pam), "N" * length
    guide = blank + n if pam_first else n + blank
    place = pam + "X" * length if pam_first else "X" * length + pam
    return Motif(alias, guide, place, True, True, distance, not pam_first, 0)


#: The known motifs (guide letters, PAM).
CATALOG = {
    m.alias: m
    for m in (
        _preset("test", 3, "G", distance=2),
        _preset("Cas9", 20, "NGG"),
        _preset("Cas9_NNN", 20, "NNN"),
        _preset("Cas9_NGA", 20, "NGA"),
        _preset("Cas9_NAG", 20, "NAG"),
        _preset("Cas9_NNGT", 20, "NNGT"),
        _preset("Cas9_NNAGAA", 20, "NNAGAA"),
        _preset("Cas9_NGGNG", 20, "NGGNG"),
        _preset("Cas12a", 21, "TTTV", pam_first=True),
        _preset("CasX", 20, "TTCN", pam_first=True),
        _preset("hfCas12Max", 22, "TNN", pam_first=True),
    )
}


def motif(alias: str, distance: int | None = None, ambig_max: int | None = None) -> Motif:
    """A preset, with another distance or limit of ambiguous letters if given."""
    if alias not in CATALOG:
        raise ValueError(f"unknown motif {alias}; known: {', '.join(CATALOG)}")
    found = CATALOG[alias]
    return replace(found, distance=found.distance if distance is None else distance, ambig_max=found.ambig_max if ambig_max is None else ambig_max)
