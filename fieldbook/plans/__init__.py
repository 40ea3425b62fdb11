"""Resources: parameters checked on the driver, then one DataFrame query."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from fieldbook.operators import relational


@dataclass(frozen=True)
class Parameter:
    """A query parameter: its column, its type, whether it takes several values with | between them, what it is if not given, and the names it had before."""

    column: str
    kind: type = str
    multi: bool = True
    longest: int = 100
    default: str | None = None
    renamed: tuple[str, ...] = ()

    def given(self, name: str, values: dict[str, str]) -> str | None:
        """The text given under the parameter's name, else under an older one, else its default."""
        return next((values[n] for n in (name, *self.renamed) if n in values), self.default)

    def parse(self, text: str) -> list:
        if len(text) > self.longest:
            raise ValueError(f"{self.column}: more than {self.longest} characters")
        parts = text.split("|") if self.multi else [text]
        return [None if p == "" else self.kind(p) for p in parts]


@dataclass(frozen=True)
class Resource:
    """A table with its parameters and the key that pages are ordered by."""

    key: list[str]
    parameters: dict[str, Parameter] = field(default_factory=dict)

    def query(self, df: DataFrame, given: dict[str, str], validate: bool = False, autocomplete: bool = False) -> DataFrame:
        """The rows that the parameters ask for; an autocomplete query without paging has a first page."""
        known = self.parameters.keys() | {n for p in self.parameters.values() for n in p.renamed}
        unknown = given.keys() - known - {"side", "per_side"}
        if validate and unknown:
            raise ValueError(f"unknown parameters: {', '.join(sorted(unknown))}")
        texts = {name: p.given(name, given) for name, p in self.parameters.items()}
        wanted = {p.column: p.parse(texts[name]) for name, p in self.parameters.items() if texts[name] is not None}
        number, size = (int(given[x]) if x in given else None for x in ("side", "per_side"))
        if autocomplete and number is None and size is None:
            number = 1
        return relational.page(relational.where(df, wanted), self.key, number, size)


def choose_table(tables: dict[str, DataFrame], given: dict[str, str], parameter: str, default: str) -> DataFrame:
    """The table that a parameter names; an unknown name is an error."""
    name = given.get(parameter, default)
    if name not in tables:
        raise ValueError(f"{parameter}: {name} is none of {', '.join(sorted(tables))}")
    return tables[name]


def represent(df: DataFrame, offered: dict[tuple[str, str], list], given: dict[str, str]) -> DataFrame:
    """The columns of the representation asked for by format and structure: JSON is nested unless asked otherwise, other formats are flat."""
    kind = given.get("format", "json")
    shape = given.get("structure", "nested" if kind == "json" else "flat")
    if (kind, shape) not in offered:
        raise ValueError(f"no {shape} structure in format {kind}")
    return df.select(*offered[kind, shape])
