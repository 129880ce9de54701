"""The canonical record, and the options of readers and writers."""

from __future__ import annotations

from dataclasses import dataclass, field

#: One row a transcript or interval; coordinates are 0-based and half-open, blocks absolute.
RECORD_DDL = "chrom string, start bigint, end bigint, name string, strand string, thick_start bigint, thick_end bigint, block_count int, block_starts array<bigint>, block_ends array<bigint>, extras map<string,array<string>>"
RECORD_COLUMNS = ("chrom", "start", "end", "name", "strand", "thick_start", "thick_end", "block_count", "block_starts", "block_ends", "extras")
INTERVALS = "array<struct<start:bigint,end:bigint>>"
EXTRAS = "map<string,array<string>>"
BED_WIDTHS = (3, 4, 5, 6, 8, 9, 12)

# Features that a transcript takes in by default, in lower case.
CHILD_FEATURES = ("exon", "cds", "start_codon", "stop_codon", "five_prime_utr", "three_prime_utr", "utr")


@dataclass(frozen=True)
class Dialect:
    """What tells one nine-column format from the other."""

    name: str
    separator: str
    parent_feature: str
    parent_attribute: str
    child_attribute: str


GTF = Dialect("GTF", " ", "transcript", "transcript_id", "transcript_id")
GFF = Dialect("GFF", "=", "mRNA", "ID", "Parent")
DIALECTS = {"gtf": GTF, "gff": GFF}


@dataclass(frozen=True)
class GroupOptions:
    """Overrides of a dialect; ``child_features`` None keeps every feature."""

    parent_feature: str | None = None
    parent_attribute: str | None = None
    child_attribute: str | None = None
    child_features: tuple[str, ...] | None = CHILD_FEATURES

    def resolved(self, d: Dialect) -> Dialect:
        return Dialect(d.name, d.separator, self.parent_feature or d.parent_feature, self.parent_attribute or d.parent_attribute, self.child_attribute or d.child_attribute)


@dataclass(frozen=True)
class WriterOptions:
    """Which extras are written (``allow`` None: all), and the source column of GTF and GFF lines."""

    numeric_extras: bool = True
    other_extras: bool = False
    allow: frozenset[str] | None = None
    source: str = "locusframe"
    additional: tuple[str, ...] = field(default=())


class FormatError(ValueError):
    """A request that no reader or writer can meet."""


def check_width(width: int) -> int:
    if width not in BED_WIDTHS:
        raise FormatError(f"unsupported BED width {width}: expected one of {', '.join(map(str, BED_WIDTHS))}")
    return width


def dialect(kind: str) -> Dialect:
    if kind.lower() not in DIALECTS:
        raise FormatError(f"unsupported layout {kind!r}: expected gtf or gff")
    return DIALECTS[kind.lower()]
