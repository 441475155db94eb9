"""Row checks: the load verdict (first failing kind) and the full validation (every failure).

Both reports of failures start from suspects, the rows that a few cheap comparisons cannot clear.
The exact checks and the messages are only worked out for them, and the scan stays a short compiled
loop.

A field that the column mapping does not name is missing in every record: it fails where it is required and
passes every other check.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowgate.functions.dates import usual_date
from rowgate.functions.messages import JOINER, LENGTH_TEXT, LOAD_DATE_TEXT, NOT_NULL_TEXT, NUMERIC_DATE_HINT, VALIDATION_DATE_TEXT
from rowgate.functions.schema import ADDRESS, DATE_FIELD, DEFAULT_CONSTRAINTS, DEFAULT_MAPPING, Constraint, FieldMapping, column_labels
from rowgate.functions.text import display_value, is_blank, is_blank_if_rare, short_value
from rowgate.operators.rows import RAW_DATE

FIELD_TYPE = "array<struct<label:string,value:string>>"


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def _field(records: DataFrame, name: str) -> Column:
    """The field, or NULL where the mapping has none."""
    return F.col(name) if name in records.columns else F.lit(None).cast("string")


def _blank_required(records: DataFrame, constraints: list[Constraint]) -> list[tuple[str, Column]]:
    return [(k.field, is_blank(_field(records, k.field))) for k in constraints if k.not_null]


def _too_long(records: DataFrame, constraints: list[Constraint]) -> list[tuple[Constraint, Column]]:
    return [(k, F.length(k.field) > k.max_len) for k in constraints if k.max_len is not None and k.field in records.columns]


def _bad_text_date(records: DataFrame) -> Column:
    if DATE_FIELD not in records.columns:
        return F.lit(False)
    return F.col(DATE_FIELD).isNull() & ~F.col("date_is_numeric") & ~is_blank_if_rare(F.col(RAW_DATE))


def _bad_load_date(records: DataFrame) -> Column:
    """The load also refuses numbers in the date cell; the validation lets them pass."""
    if DATE_FIELD not in records.columns:
        return F.lit(False)
    return _bad_text_date(records) | (F.col("date_is_numeric") & F.col(RAW_DATE).isNotNull())


def _suspect(records: DataFrame, constraints: list[Constraint]) -> Column:
    """True for every row with a failure, and for rows whose date has an unusual spelling."""
    date = []
    if DATE_FIELD in records.columns:
        raw = F.col(RAW_DATE)
        date = [F.coalesce((raw != "") & (usual_date(raw).isNull() | F.col("date_is_numeric")), F.lit(False))]
    return _any([c for _, c in _blank_required(records, constraints)] + date + [c for _, c in _too_long(records, constraints)])


def _not_null_message(names: Column) -> Column:
    before, after = NOT_NULL_TEXT
    return F.concat(F.lit(before), names, F.lit(after))


def _length_message(k: Constraint) -> Column:
    before, middle, after = LENGTH_TEXT
    return F.concat(F.lit(f"{before}{k.field}{middle}"), F.length(k.field).cast("string"), F.lit(f"{after}{k.max_len}"))


def with_verdict(records: DataFrame, constraints: list[Constraint] = DEFAULT_CONSTRAINTS) -> DataFrame:
    """Adds `kind`: the first failing check of null, date, length; NULL for a clean row."""
    return records.withColumn(
        "kind",
        F.when(_any([c for _, c in _blank_required(records, constraints)]), "null")
        .when(_bad_load_date(records), "date")
        .when(_any([c for _, c in _too_long(records, constraints)]), "length"),
    )


def clean_rows(records: DataFrame, constraints: list[Constraint] = DEFAULT_CONSTRAINTS) -> DataFrame:
    return with_verdict(records, constraints).where(F.col("kind").isNull()).drop("kind")


def _found(records: DataFrame, constraints: list[Constraint], mapping: list[FieldMapping]) -> Column:
    """Kind, message and fields of a row with a `kind`."""
    labels = column_labels(mapping)

    def field(name: str, value: Column) -> Column:
        return F.struct(F.lit(labels.get(name, name)).alias("label"), display_value(value).alias("value"))

    def hits(pairs: list[tuple[Column, Column]]) -> Column:
        return F.array_compact(F.array(*[F.when(cond, item) for cond, item in pairs]))

    blank, long = _blank_required(records, constraints), _too_long(records, constraints)
    raw = _field(records, RAW_DATE)
    number = F.col("date_is_numeric") if "date_is_numeric" in records.columns else F.lit(False)
    before, row, value, after = LOAD_DATE_TEXT
    date_message = F.concat(
        F.lit(f"{before}{DATE_FIELD}{row}"), F.col("row_num").cast("string"), F.lit(value), display_value(raw), F.lit(after),
        F.when(number, F.lit(NUMERIC_DATE_HINT)).otherwise(F.lit("")),
    )
    message = (
        F.when(
            F.col("kind") == "null",
            _not_null_message(F.concat_ws(", ", *[F.when(cond, F.lit(name)) for name, cond in blank])),
        )
        .when(F.col("kind") == "date", date_message)
        .otherwise(F.concat_ws(JOINER, *[F.when(cond, _length_message(k)) for k, cond in long]))
    )
    fields = (
        F.when(F.col("kind") == "null", hits([(cond, field(name, _field(records, name))) for name, cond in blank]).cast(FIELD_TYPE))
        .when(F.col("kind") == "date", F.array(field(DATE_FIELD, raw)).cast(FIELD_TYPE))
        .otherwise(hits([(cond, field(k.field, F.col(k.field))) for k, cond in long]).cast(FIELD_TYPE))
    )
    return F.struct("kind", message.alias("message"), fields.alias("fields"))


def checked_rows(
    records: DataFrame,
    constraints: list[Constraint] = DEFAULT_CONSTRAINTS,
    mapping: list[FieldMapping] = DEFAULT_MAPPING,
) -> DataFrame:
    """One narrow row per record: the address and, for a failing record, `found` (kind, message, fields), team and company
    name. Both the gate and the reports of a load can be made from it, so the input is checked once."""
    suspects = records.withColumn("_suspect", _suspect(records, constraints))
    kind = with_verdict(suspects, constraints)
    bad = F.col("_suspect") & F.col("kind").isNotNull()
    return kind.select(
        *ADDRESS, F.when(bad, _found(records, constraints, mapping)).alias("found"),
        *[F.when(bad, _field(records, c)).alias(c) for c in ("team", "company_name")],
    )


def found_errors(checked: DataFrame) -> DataFrame:
    """The failing rows of checked_rows, in the shape of load_errors."""
    return checked.where(F.col("found").isNotNull()).select(*ADDRESS, "found.*", "team", "company_name")


def load_errors(
    records: DataFrame,
    constraints: list[Constraint] = DEFAULT_CONSTRAINTS,
    mapping: list[FieldMapping] = DEFAULT_MAPPING,
) -> DataFrame:
    """One row per failing record: kind, message, the offending fields with their shown values, and
    the owner and company of the row."""
    suspects = with_verdict(records.where(_suspect(records, constraints)), constraints)
    return (
        suspects.select(*ADDRESS, _field(records, "team").alias("team"), _field(records, "company_name").alias("company_name"),
                        F.when(F.col("kind").isNotNull(), F.array(_found(records, constraints, mapping))).alias("_found"))
        .select(*ADDRESS, "team", "company_name", F.explode_outer("_found").alias("f"))
        .where(F.col("f").isNotNull())
        .select(*ADDRESS, "f.*", "team", "company_name")
    )


def writer_errors(failed: DataFrame) -> DataFrame:
    """Rows a writer refused (address, message, team, company_name) in the shape of load_errors."""
    return failed.select(
        *ADDRESS,
        F.lit("db").alias("kind"),
        "message",
        F.array().cast(FIELD_TYPE).alias("fields"),
        "team",
        "company_name",
    )


def validation_errors(records: DataFrame, constraints: list[Constraint] = DEFAULT_CONSTRAINTS) -> DataFrame:
    """One row per failed check, in constraint order (`check_pos`). A blank required field has no
    further findings; numbers pass as dates."""

    def finding(pos: int, k: Constraint, value: Column, reason: str, message: Column) -> Column:
        return F.struct(
            F.lit(pos).alias("check_pos"),
            F.lit(k.field).alias("field"),
            short_value(value).alias("value"),
            F.lit(reason).alias("reason"),
            message.alias("message"),
        )

    tests: list[tuple[Column, Column]] = []
    pos = -1
    for k in constraints:
        value = _field(records, RAW_DATE if k.is_date else k.field)
        missing = is_blank(value) if k.not_null else F.lit(False)
        if k.not_null:
            pos += 1
            tests.append((missing, finding(pos, k, value, "NOT NULL", _not_null_message(F.lit(k.field)))))
        if k.max_len is not None:
            pos += 1
        if k.max_len is not None and k.field in records.columns:
            tests.append((~missing & (F.length(k.field) > k.max_len), finding(pos, k, value, "LENGTH", _length_message(k))))
        if k.is_date:
            pos += 1
            tests.append((~missing & _bad_text_date(records), finding(pos, k, value, "DATE", F.lit(k.field.join(VALIDATION_DATE_TEXT)))))
    findings = F.array_compact(F.array(*[F.when(cond, item) for cond, item in tests]))
    return (
        records.where(_suspect(records, constraints))
        .select(*ADDRESS, findings.alias("_found"))
        .select(*ADDRESS, F.explode_outer("_found").alias("f"))
        .where(F.col("f").isNotNull())
        .select(*ADDRESS, "f.*")
    )


def validation_by_sheet(records: DataFrame, errors: DataFrame, sheets: DataFrame | None = None) -> DataFrame:
    """Rows, findings and rows with findings per sheet. `sheets` (sheet_name, sheet_order) are the selected ones; those without
    rows appear with zeros. Without it, only sheets that have rows appear."""
    rows = records.groupBy("sheet_name", "sheet_order").agg(F.count(F.lit(1)).alias("n_rows"))
    found = (
        errors.groupBy("sheet_name", "row_num")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("sheet_name")
        .agg(F.sum("n").alias("n_errors"), F.count(F.lit(1)).alias("n_error_rows"))
    )
    if sheets is not None:
        rows = sheets.select("sheet_name", "sheet_order").join(rows.drop("sheet_order"), "sheet_name", "left")
    zero = F.lit(0).cast("bigint")
    return rows.join(found, "sheet_name", "left").select(
        "sheet_name",
        "sheet_order",
        *[F.coalesce(c, zero).alias(c) for c in ("n_rows", "n_errors", "n_error_rows")],
    )


def validation_totals(by_sheet: DataFrame) -> DataFrame:
    """Totals over the selected sheets (the rows of validation_by_sheet)."""
    return by_sheet.agg(
        F.count(F.lit(1)).alias("total_sheets"),
        F.coalesce(F.sum("n_rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.coalesce(F.sum("n_errors"), F.lit(0)).cast("bigint").alias("total_errors"),
    ).withColumn("valid", F.col("total_errors") == 0)
