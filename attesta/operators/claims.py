"""Many claims against the cells of artifacts, and numbers of prose against claims, as joins.

A claim names an artifact, a column and the texts that other columns have in its row. For each artifact, a row is put
under one key for each set of columns that claims filter by. Where claims ask for few keys of a set, these are broadcast:
rows of other keys go at once, and claims stay where they are. Rows are counted by key before they move, so a key that a
third of all rows have is one row when the two meet. A number of prose is looked up among the claims' values, rounded to
the decimals that it shows, by narrow ranges of the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import storage
from ..functions.numbers import double_text, is_close, is_plain_double_text, parsed_number, rounded_half_even
from ..sources.names import quoted

#: A number in prose: sign, currency, digits with thousands, decimals, percent; fixed value.
NUMBER = r"[-+]?\$?\d[\d,]*(?:\.\d+)?%?"
CLAIM = "finding_id string, claim int, artifact_id string, column string, where map<string,string>, value double, rel_tol double, abs_tol double"
#: Sets of filter columns that one pass over an artifact serves.
SETS = 64
#: Rows of keys that may be broadcast.
BROADCAST_ROWS = 500_000
#: How near a rounded value must be to a number of prose, absolutely or in proportion.
NEAR = 1e-9

_FLOATS = (T.DoubleType, T.FloatType)


def prose_numbers(text: Column) -> Column:
    """All numbers in a text column, as an array."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0))


def _text(kind: T.DataType, c: Column) -> Column:
    """The text by which a cell is found; doubles as the engine writes them."""
    return c.cast("double").cast("string") if isinstance(kind, _FLOATS) else F.to_json(c) if isinstance(kind, (T.MapType, T.ArrayType, T.StructType)) else c.cast("string")


def _cell(kind: T.DataType, c: Column) -> Column:
    """(number, shown): a cell as a finite number, null if it is none, and how a reason shows it."""
    none, number, shown = F.lit(None).cast("double"), None, c.cast("string") if not isinstance(kind, (T.MapType, T.ArrayType, T.StructType)) else F.to_json(c)
    if isinstance(kind, T.NumericType):
        x = c.cast("double")
        number, shown = F.when(F.abs(x) < float("inf"), x), double_text(x) if isinstance(kind, _FLOATS) else shown
    elif isinstance(kind, T.StringType):
        number, shown = parsed_number(c), F.concat(F.lit("'"), c, F.lit("'"))
    elif isinstance(kind, T.BooleanType):
        shown = F.when(c, "True").otherwise("False")
    return F.struct((none if number is None else number).alias("number"), F.when(c.isNull(), "None").otherwise(shown).alias("shown"))


def _matched(data: DataFrame, keys: DataFrame | None, sets: dict[int, tuple[str, ...]], columns: list[str]) -> DataFrame:
    """(set, texts, n, cells): how many rows have a key (set, texts), and the claimed cells of one such row.

    keys are few, and broadcast; without them all keys of the rows are counted. Either way rows are counted where they are
    before they go to their key's task, as any part of them may have one key.
    """
    kinds = {f.name: f.dataType for f in data.schema}
    under = [F.struct(F.lit(k).alias("set"), F.array(*(_text(kinds[c], F.col(quoted(c))) for c in own)).cast("array<string>").alias("texts")) for k, own in sets.items()]
    cells = F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*(_cell(kinds[c], F.col("_row").getField(c)) for c in columns)))
    rows = data.select(F.explode(F.array(*under)).alias("_key"), F.struct(*(F.col(quoted(c)) for c in columns)).alias("_row")).select("_key.set", "_key.texts", "_row")
    met = rows.where(~F.exists("texts", lambda t: t.isNull()))
    if keys is not None:
        met = met.join(F.broadcast(keys), ["set", "texts"])
    one = met.groupBy("set", "texts").agg(F.count("*").alias("n"), F.first("_row").alias("_row"))
    return one.select("set", "texts", "n", F.when(F.col("n") == 1, cells).alias("cells"))


def _checked(claims: DataFrame, data: DataFrame) -> DataFrame:
    """Claims on one artifact with n, number and shown of the cell, and unknown columns."""
    names = F.array(*map(F.lit, data.columns)).cast("array<string>")
    floats = F.array(*(F.lit(f.name) for f in data.schema if isinstance(f.dataType, _FLOATS))).cast("array<string>")
    wanted = F.array_distinct(F.concat(F.array("column"), F.map_keys("where")))
    claims = claims.withColumn("unknown", F.sort_array(F.array_except(wanted, names))).withColumn("columns", F.sort_array(F.map_keys("where")))
    # the text of a double has to be written as Python writes it, and is then read as a number
    asked = lambda c: F.when(F.array_contains(floats, c), F.when(is_plain_double_text(F.col("where")[c]), _as_double(F.col("where")[c]).cast("string"))).otherwise(F.col("where")[c])
    known = claims.where(F.size("unknown") == 0)
    bad = claims.where(F.size("unknown") > 0).withColumns({"n": F.lit(None).cast("long"), "cell": F.lit(None).cast("struct<number:double,shown:string>")})
    asked_for = known.select("column", "columns").distinct().collect()
    columns, sets = sorted({r[0] for r in asked_for}), sorted({tuple(r[1]) for r in asked_for})
    out = bad.drop("columns")
    for k in range(0, len(sets), SETS):
        some = sets[k : k + SETS]
        numbers = F.map_from_arrays(F.array(*(F.to_json(F.array(*map(F.lit, s)).cast("array<string>")) for s in some)), F.array(*map(F.lit, range(len(some)))))
        own = known.withColumn("set", F.try_element_at(numbers, F.to_json("columns"))).where("set is not null").withColumn("texts", F.transform("columns", asked))
        keys = own.where(~F.exists("texts", lambda t: t.isNull())).select("set", "texts").distinct()
        few, many, left = dict(enumerate(some)), {}, BROADCAST_ROWS
        for r in keys.groupBy("set").count().orderBy("count").collect():
            left -= r["count"]
            if left < 0:
                many[r["set"]] = few.pop(r["set"])
        parts = []
        if few:
            found = _matched(data, keys.where(F.col("set").isin(list(few))), few, columns)
            parts.append(own.where(F.col("set").isin(list(few))).join(F.broadcast(found), ["set", "texts"], "left"))
        if many:
            # stored, so that Spark sees the sizes of both sides and splits a key that many claims have
            found = storage.written(_matched(data, None, many, columns), "matched")
            parts.append(own.where(F.col("set").isin(list(many))).join(found.hint("merge"), ["set", "texts"], "left"))
        for met in parts:
            met = met.withColumn("cell", F.try_element_at("cells", F.col("column"))).withColumn("n", F.coalesce("n", F.lit(0)))
            out = out.unionByName(met.select(*out.columns))
    return out


def _as_double(text: Column) -> Column:
    return F.when(text == "nan", float("nan")).when(text == "inf", float("inf")).when(text == "-inf", float("-inf")).otherwise(parsed_number(text))


def check_claims(claims: DataFrame, artifacts: dict[str, DataFrame | None]) -> DataFrame:
    """(finding_id, claim, ok, actual, reason), a row for each row of claims (see CLAIM).

    artifacts has the data of the ids that there are; None for one without a table. Each is read once or twice for any
    number of claims, which are stored first. A null in `where` is a text that no cell has.
    """
    return _check_stored(storage.written(claims, "claims"), artifacts)


def _check_stored(claims: DataFrame, artifacts: dict[str, DataFrame | None]) -> DataFrame:
    text = lambda a: F.array_join(a, ", ")
    ok = is_close(F.col("actual"), F.col("value"), F.col("rel_tol"), F.col("abs_tol"))
    parts = []
    for rid, data in artifacts.items():
        own = claims.where(F.col("artifact_id") == rid)
        if data is None:
            parts.append(own.select("finding_id", "claim", F.lit(False).alias("ok"), F.lit(None).cast("double").alias("actual"), F.lit("artifact has no tabular result").alias("reason")))
            continue
        c = _checked(own, data).withColumn("actual", F.when(F.col("n") == 1, F.col("cell.number")))
        reason = (
            F.when(F.size("unknown") > 0, F.concat(F.lit("unknown column(s): "), text("unknown")))
            .when(F.col("n") != 1, F.concat(F.lit("expected exactly 1 matching row, got "), F.col("n").cast("string")))
            .when(F.col("actual").isNull(), F.concat(F.lit("cell value "), F.col("cell.shown"), F.lit(" is not numeric")))
            .when(~ok, F.concat(F.lit("claimed "), double_text(F.col("value")), F.lit(" but artifact cell is "), double_text(F.col("actual"))))
            .otherwise("")
        )
        parts.append(c.select("finding_id", "claim", ok.alias("ok"), "actual", reason.alias("reason")))
    lost = claims.where(~F.coalesce(F.col("artifact_id").isin(list(artifacts)), F.lit(False))) if artifacts else claims
    name = F.concat(F.lit("no artifact '"), F.coalesce("artifact_id", F.lit("None")), F.lit("'"))
    out = lost.select("finding_id", "claim", F.lit(False).alias("ok"), F.lit(None).cast("double").alias("actual"), name.alias("reason"))
    for p in parts:
        out = out.unionByName(p)
    return out


def _bin(x: Column) -> Column:
    """Ranges of numbers twice as wide as what is near, on a scale that is even about 0 and grows in proportion beyond."""
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) / (2 * NEAR)).cast("long")


def unbacked_numbers(findings: DataFrame, claims: DataFrame) -> DataFrame:
    """(finding_id, place, token): numbers in the prose of findings (finding_id, prose) that no value of its claims backs.

    A value backs a number if it is equal when rounded to the decimals shown. Markers of percent and currency and
    thousands separators don't count; places are those among the numbers of the prose, from 0.
    """
    tokens = findings.select("finding_id", F.posexplode(prose_numbers(F.coalesce("prose", F.lit("")))).alias("place", "token"))
    plain = F.regexp_replace(F.regexp_replace("token", r"[$,]", ""), "%+$", "")
    tokens = storage.written(tokens.withColumn("shown", plain.cast("double")).withColumn("decimals", F.length(F.split_part(plain, F.lit("."), F.lit(2)))), "tokens")
    # merged, as stored tables take little room and look as if they could be broadcast
    asked = tokens.select("finding_id", "shown", "decimals").distinct()
    values = claims.select("finding_id", "value").where("value is not null").distinct().join(asked.select("finding_id", "decimals").distinct().hint("merge"), "finding_id")
    rounded = values.select("finding_id", "decimals", rounded_half_even(F.col("value"), F.col("decimals")).alias("r")).distinct().withColumn("bin", _bin(F.col("r")))
    near = asked.withColumn("bin", F.explode(F.array(*(_bin(F.col("shown")) + k for k in (-1, 0, 1)))))
    backed = near.join(rounded.hint("merge"), ["finding_id", "decimals", "bin"]).where(is_close(F.col("r"), F.col("shown"), F.lit(NEAR), F.lit(NEAR)))
    return tokens.join(backed.select("finding_id", "shown", "decimals").distinct().hint("merge"), ["finding_id", "shown", "decimals"], "left_anti").select("finding_id", "place", "token")


def verdicts(findings: DataFrame, claims: DataFrame, artifacts: dict[str, DataFrame | None]) -> DataFrame:
    """(finding_id, verified, n_claims, n_failed, n_unbacked) of findings (finding_id, prose): all claims hold and all numbers
    of the prose are backed. A finding without claims and numbers is verified."""
    claims = storage.written(claims, "claims")
    checks = _check_stored(claims, artifacts).groupBy("finding_id").agg(F.count("*").alias("n_claims"), F.count_if(~F.col("ok")).alias("n_failed"))
    loose = unbacked_numbers(findings, claims).groupBy("finding_id").agg(F.count("*").alias("n_unbacked"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = findings.select("finding_id").join(checks, "finding_id", "left").join(loose, "finding_id", "left").select("finding_id", *map(zero, ("n_claims", "n_failed", "n_unbacked")))
    return out.withColumn("verified", (F.col("n_failed") == 0) & (F.col("n_unbacked") == 0))
