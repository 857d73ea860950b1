"""Table synchronisation as DataFrame plans, and the same as T-SQL text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .infer import _c


def _aligned(source: DataFrame, source_columns: list[str], target_columns: list[str]) -> DataFrame:
    if len(source_columns) != len(target_columns):
        raise ValueError("source and target columns differ in number")
    return source.select(*[_c(s).alias(t) for s, t in zip(source_columns, target_columns, strict=True)])


def merge(target: DataFrame, source: DataFrame, id_column: str, source_columns: list[str] | None = None, target_columns: list[str] | None = None, source_id: str | None = None, delete_unmatched: bool = True, null_safe: bool = False) -> DataFrame:
    """The target after the merge; one full outer join on the id.

    A matched row takes the source's values if some column differs or is null only in the
    target; a null in the source alone changes nothing unless `null_safe`. Unmatched source
    rows are added; unmatched target rows go if `delete_unmatched`. Null ids match nothing.
    A target row that several source rows match fails the query, for nothing says which of
    them holds; source rows that share an id the target lacks are all added. Columns outside
    `target_columns` keep their values, and are null in added rows. `source_id` names the
    source's id, by default the column that goes into the target's id.
    """
    target_columns = target_columns or target.columns
    source_columns = source_columns or target_columns
    if source_id is None and id_column not in target_columns:
        raise ValueError("source_id must be given where the id isn't among the target columns")
    source_id = source_id or source_columns[target_columns.index(id_column)]
    if len(source_columns) != len(target_columns):
        raise ValueError("source and target columns differ in number")
    b = source.select(F.struct(*[_c(s).alias(t) for s, t in zip(source_columns, target_columns, strict=True)]).alias("b"), _c(source_id).alias("kb"))
    several = b.where("kb IS NOT NULL").groupBy(F.col("kb").alias("kc")).agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    a = target.select(F.struct(*[_c(c) for c in target.columns]).alias("a"), _c(id_column).alias("ka"))
    both = a.join(several, F.col("ka") == F.col("kc"), "left").join(b, F.col("ka") == F.col("kb"), "full_outer")

    def changed(c: str) -> Column:
        x, y = F.col("a")[c], F.col("b")[c]
        if null_safe:
            return ~x.eqNullSafe(y)
        return F.coalesce(x != y, F.lit(False)) | (x.isNull() & y.isNotNull())

    update = F.lit(False)
    for c in target_columns:
        if c != id_column:
            update = update | changed(c)
    takes = F.col("a").isNull() | (F.col("b").isNotNull() & update)
    row = F.struct(*[(F.when(takes, F.col("b")[c]).otherwise(F.col("a")[c]) if c in target_columns else F.col("a")[c]).alias(c) for c in target.columns])
    clash = F.col("c").isNotNull() & F.col("b").isNotNull()
    row = F.when(clash, F.raise_error(F.concat(F.lit("merge: several source rows match the id "), F.col("ka").cast("string")))).otherwise(row)
    if delete_unmatched:
        both = both.where(F.col("b").isNotNull())
    return both.select(row.alias("r")).select("r.*")


def upsert(target: DataFrame, source: DataFrame, id_column: str, source_columns: list[str] | None = None, target_columns: list[str] | None = None) -> DataFrame:
    """The target after an upsert: source rows that it has already are left out (nulls equal), rows with an id among the rest are replaced.

    Columns outside `target_columns` are null in the rows that come from the source.
    """
    target_columns = target_columns or target.columns
    source = _aligned(source, source_columns or target_columns, target_columns)
    known = target.select(*[_c(c) for c in target_columns]).toDF(*[f"k{i}" for i in range(len(target_columns))]).distinct()
    same = F.lit(True)
    for i, c in enumerate(target_columns):
        same = same & _c(c).eqNullSafe(F.col(f"k{i}"))
    new = source.join(known, same, "left_anti")
    ids = new.select(_c(id_column).alias("__id")).distinct()
    return target.join(ids, _c(id_column) == F.col("__id"), "left_anti").unionByName(new, allowMissingColumns=True)


def append(target: DataFrame, source: DataFrame, source_columns: list[str] | None = None, target_columns: list[str] | None = None) -> DataFrame:
    """The target with the distinct source rows that it lacks, columns by position, nulls equal; its other columns are null in them."""
    target_columns = target_columns or target.columns
    have = target.select(*[_c(c) for c in target_columns])
    return target.unionByName(_aligned(source, source_columns or target_columns, target_columns).subtract(have), allowMissingColumns=True)


@dataclass(frozen=True)
class SyncSql:
    """T-SQL text of the three ways to bring a stage table into a target."""

    source_schema: str
    source_table: str
    source_columns: list[str]
    source_id: str
    target_schema: str
    target_table: str
    target_columns: list[str]
    target_id: str

    @property
    def _stage(self) -> str:
        return f"{self.source_schema}.{self.source_table}"

    @property
    def _target(self) -> str:
        return f"{self.target_schema}.{self.target_table}"

    def merge(self, delete_unmatched: bool = True) -> str:
        if len(self.source_columns) != len(self.target_columns):
            raise ValueError("source and target columns differ in number")
        pairs = [(t, s) for s, t in zip(self.source_columns, self.target_columns, strict=True) if t != self.target_id]
        differs = " or ".join(f"a.[{t}] <> b.[{s}] or (a.[{t}] is null and b.[{s}] is not null) " for t, s in pairs)
        lines = [
            f"merge {self._target} a",
            f"using {self._stage} b",
            f"on a.[{self.target_id}] = b.[{self.source_id}]",
            f"when matched and ({differs}) then",
            "\tupdate",
            "\tset " + ",\n\t\t".join(f"a.[{t}] = b.[{s}]" for t, s in pairs),
            "when not matched by target then",
            f"\tinsert ({_listed(self.target_columns)})",
            f"\tvalues ({_listed(self.source_columns, 'b.')})",
        ]
        return "\n".join(lines + ["when not matched by source then delete"] * delete_unmatched) + ";"

    def upsert(self) -> str:
        known = f"select {_listed(self.source_columns, 's.')} intersect select {_listed(self.target_columns)} from {self._target}"
        ids = f"select {self.source_id} from {self._stage} intersect select {self.target_id} from {self._target}"
        return " ".join([
            f"Delete from {self._stage} from {self._stage} s where exists ({known});",
            f"delete from {self._target} where {self.target_id} in ( {ids});",
            f"insert into {self._target} ({_listed(self.target_columns)}) select {_listed(self.source_columns)} from {self._stage};",
        ])

    def append(self) -> str:
        mine, theirs = _listed(self.target_columns, sep=","), _listed(self.source_columns, sep=",")
        return f"insert into {self._target} ({mine}) select {theirs} from {self._stage} except select {mine} from {self._target}"


def _listed(columns: list[str], prefix: str = "", sep: str = ", ") -> str:
    return sep.join(f"{prefix}[{c}]" for c in columns)
