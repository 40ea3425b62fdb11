"""Change feeds and derived tables: event ranges, transactions, processors from bitemporal rows to current ones, execution order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from graphlib import TopologicalSorter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldbook.functions import ranges
from fieldbook.operators import changes, relational


def between(df: DataFrame, **bounds: tuple) -> DataFrame:
    """Closed ranges by column; an end that is None is open. The tests are plain comparisons, so they reach the scan and prune partitions."""
    for column, (lo, hi) in bounds.items():
        if lo is not None:
            df = df.filter(F.col(column) >= lo)
        if hi is not None:
            df = df.filter(F.col(column) <= hi)
    return df


def events(history: DataFrame, transactions: DataFrame | None, order: str, transaction_id: str, **bounds: tuple) -> DataFrame:
    """The events of sequence, time or transaction ranges in sequence order; a range of transactions asks for the transactions table, whose columns are added."""
    if transaction_id in bounds:
        if transactions is None:
            raise ValueError("a range of transactions needs the transactions")
        history = history.join(between(transactions, **{transaction_id: bounds[transaction_id]}), transaction_id)
    return between(history, **{k: v for k, v in bounds.items() if k != transaction_id}).orderBy(order)


def checked_sequence(history: DataFrame, wanted: int, seq: str = "seq") -> int:
    """The wanted sequence number, which must not be later than the latest."""
    latest = history.agg(F.max(seq)).first()[0] or 0
    if wanted > latest:
        raise ValueError(f"sequence number {wanted} is later than the latest, {latest}")
    return wanted


def transaction(done: DataFrame, found: DataFrame, order: list[str], keep_empty: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(found with txid and seq, the transaction's own row) after the transactions ``done``(txid, seq_to, ...).

    The next txid and sequence numbers follow the highest so far; only public changes get a number. Without changes there is no
    transaction (row None) unless it is kept on purpose.
    """
    last = done.agg(F.max("txid").alias("t"), F.max("seq_to").alias("s")).first()
    txid, start = (last["t"] or 0) + 1, last["s"] or 0
    named = found.withColumn("txid", F.lit(txid).cast("long"))
    public = relational.numbered(named.where("public"), order, "seq", start)
    marked = public.unionByName(named.where(~F.coalesce("public", F.lit(False))).withColumn("seq", F.lit(None).cast("long")))
    row = marked.agg(
        F.first("txid").alias("txid"), F.min("seq").alias("seq_from"), F.max("seq").alias("seq_to"),
        *[F.count_if(F.col("operation") == o).alias(f"n_{o}") for o in ("insert", "update", "delete")],
    )
    if not keep_empty and found.isEmpty():
        return marked, None
    return marked, row.withColumn("txid", F.lit(txid).cast("long"))


def in_table_order(found: DataFrame, tables: list[str], table: str = "table") -> DataFrame:
    """Changes of several tables with ``table_order``: deletes first, from the last table to the first, then inserts and updates from the first to the last, so that no row refers to one that is not there. A table that is not listed is an error."""
    place = F.array_position(F.array(*[F.lit(x) for x in tables]), F.col(table)).cast("int")
    known = F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("no such table: "), F.coalesce(F.col(table), F.lit("null")))))
    return found.withColumn("table_order", F.when(F.col("operation") == "delete", -known).otherwise(known))


def puts_and_deletes(target: DataFrame, puts: DataFrame, deletes: DataFrame, key: list[str]) -> DataFrame:
    """The changes that rows put and keys deleted make: only those keys are compared, and deletes of absent keys are none."""
    gone = target.join(deletes.select(*key), key, "left_semi").join(puts.select(*key), key, "left_anti")
    here = target.join(puts.select(*key), key, "left_semi")
    return changes.diff(puts.select(*target.columns), here.unionByName(gone), key)


def initial_history(table: DataFrame, txid: int) -> DataFrame:
    """A table's change history cleared and begun anew: one insert a row, none of them public."""
    return table.select(F.lit(txid).cast("long").alias("txid"), F.lit("insert").alias("operation"), F.lit(False).alias("public"), "*")


def hidden(found: DataFrame) -> DataFrame:
    """Changes of a recomputation that readers of the feed needn't see."""
    return found.withColumn("public", F.lit(False))


def open_registrations(bitemporal: DataFrame, reg_to: str) -> DataFrame:
    """The slice of transaction time that holds now."""
    return bitemporal.filter(F.col(reg_to).isNull())


def history_of(bitemporal: DataFrame, key: list[str], attrs: list[str], lo: str, hi: str, reg_to: str) -> DataFrame:
    """Bitemporal rows to a history by valid time: open registrations, neighbours that agree made one."""
    return ranges.coalesce_valid_time(open_registrations(bitemporal, reg_to).select(*key, *attrs, lo, hi), key, attrs, lo, hi)


def current_of(history: DataFrame, lo: str, hi: str, now: Column) -> DataFrame:
    """The rows of a history that are valid now."""
    return history.filter(ranges.contains(F.col(lo), F.col(hi), now)).drop(lo, hi)


def current_changes(history: DataFrame, changed: DataFrame, current: DataFrame, key: list[str], lo: str, hi: str, before: Column, now: Column) -> DataFrame:
    """The current table's changes, from keys that changed or whose versions began or ended between two clock readings only."""
    moved = history.filter(ranges.became_valid(F.col(lo), F.col(hi), before, now)).select(*key)
    dirty = changed.select(*key).unionByName(moved).distinct()
    return changes.diff_subset(current_of(history, lo, hi, now).select(*current.columns), current, dirty, key)


def combined_history(old: DataFrame, new: DataFrame, key: list[str], attrs: list[str], lo: str, hi: str, cut: Column) -> DataFrame:
    """The old register's history before the cut and the new one's from it on, joined where they meet and agree."""
    both = ranges.clip(old, lo, hi, cut, before=True).select(*key, *attrs, lo, hi).unionByName(ranges.clip(new, lo, hi, cut, before=False).select(*key, *attrs, lo, hi))
    return ranges.coalesce_valid_time(both, key, attrs, lo, hi)


def execution_order(needs: dict[str, Iterable[str]], asked: Iterable[str]) -> list[str]:
    """The asked components and all that depend on them, each after what it needs."""
    wanted, grown = set(asked), True
    while grown:
        more = {c for c, n in needs.items() if c not in wanted and wanted & set(n)}
        wanted, grown = wanted | more, bool(more)
    return [c for c in TopologicalSorter({c: sorted(n) for c, n in needs.items()}).static_order() if c in wanted]


def execute(order: list[str], needs: dict[str, Iterable[str]], steps: dict[str, Callable[[], int]], strategy: str = "quick") -> dict[str, int]:
    """Changes made by each step. QUICK passes over steps none of whose needs changed; SLOW runs all; VERIFY runs all and lets none change what is verified."""
    if strategy not in ("quick", "slow", "verify"):
        raise ValueError(f"unknown strategy {strategy}")
    made: dict[str, int] = {}
    for c in order:
        before = [made[n] for n in needs.get(c, ()) if n in made]
        if strategy == "quick" and before and not any(before):
            made[c] = 0
            continue
        made[c] = steps[c]()
        if strategy == "verify" and before and made[c]:
            raise ValueError(f"{c} was not up to date: {made[c]} changes")
    return made


def client_mode(replica_rows: int, force: bool, local_txid: int | None, remote_txid: int) -> str:
    """What a replica does next: download whole tables, take the changes since its transaction, or nothing."""
    if force or local_txid is None or not replica_rows:
        return "download"
    if local_txid > remote_txid:
        raise ValueError(f"the replica's transaction {local_txid} is later than the source's, {remote_txid}")
    return "increment" if local_txid < remote_txid else "none"
