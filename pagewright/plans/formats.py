"""Queries over number and date formats, with SQL for the codes that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagewright.functions import numfmt
from pagewright.plans.tables import read


def _line(s, d):
    return read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_quantity").alias("quantity")
    )


def _shown(s, d, value, code):
    """One row for each line: the value in a format, by the format engine."""
    return _line(s, d).select(
        "l_orderkey", "l_linenumber", "l_partkey", numfmt.format_column(value, F.lit(code)).alias("shown")
    )


def _by_code(s, d):
    """Many codes at once: the engine on all kinds of codes, without SQL."""
    codes = [c for c in numfmt.BUILTIN.values() if c != "@"] + ["[>=1000]#,##0.0;[<0]-0;0.00", "# ??/16", '"n"0.0"x"', "[mm]:ss", "yyyy\\-mm\\-dd hh:mm:ss.000"]
    each = read(s, d, "part").select("p_partkey", F.posexplode(F.array(*[F.lit(c) for c in codes])).alias("at", "code"))
    value = (F.col("p_partkey") * 137.25) % 60000 + F.col("at") / 7
    return each.select("p_partkey", "code", numfmt.format_column(value, F.col("code")).alias("shown"))


_KEYS = "l_orderkey, l_linenumber, l_partkey"

QUERIES = {
    "fmt_number": (
        lambda s, d: _shown(s, d, F.floor(F.col("price")) + 0.25, "#,##0.00"),
        f"SELECT {_KEYS}, format('{{:,}}', CAST(floor(l_extendedprice) AS BIGINT)) || '.25' AS shown FROM lineitem",
    ),
    "fmt_fixed": (
        lambda s, d: _line(s, d).select("l_orderkey", "l_linenumber", "l_partkey", numfmt.fixed(F.floor(F.col("price") * 8) / 8, 1, True).alias("shown")),
        f"""WITH v AS (SELECT {_KEYS}, CAST(floor(floor(l_extendedprice * 8) / 8 * 10 + 0.5) AS BIGINT) AS t FROM lineitem)
            SELECT {_KEYS}, format('{{:,}}', t // 10) || '.' || t % 10 AS shown FROM v""",
    ),
    "fmt_percent": (
        lambda s, d: _shown(s, d, F.col("discount"), "0%"),
        f"SELECT {_KEYS}, CAST(floor(l_discount * 100 + 0.5) AS INTEGER) || '%' AS shown FROM lineitem",
    ),
    "fmt_padded": (
        lambda s, d: _shown(s, d, F.col("quantity"), "00000"),
        f"SELECT {_KEYS}, lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 5, '0') AS shown FROM lineitem",
    ),
    "fmt_sections": (
        lambda s, d: _shown(s, d, F.floor(F.col("quantity") - 25), '0;(0);"none"'),
        f"""WITH v AS (SELECT {_KEYS}, CAST(floor(l_quantity - 25) AS INTEGER) AS v FROM lineitem)
            SELECT {_KEYS}, CASE WHEN v > 0 THEN v::VARCHAR WHEN v < 0 THEN '(' || -v || ')' ELSE 'none' END AS shown FROM v""",
    ),
    "fmt_conditions": (
        lambda s, d: _shown(s, d, F.col("quantity"), '[>=40]"high "0;[<10]"low "0;0'),
        f"""WITH v AS (SELECT {_KEYS}, CAST(l_quantity AS INTEGER) AS v FROM lineitem)
            SELECT {_KEYS}, CASE WHEN v >= 40 THEN 'high ' WHEN v < 10 THEN 'low ' ELSE '' END || v AS shown FROM v""",
    ),
    "fmt_sci": (
        lambda s, d: _shown(s, d, F.pow(F.lit(10.0), F.col("quantity") % 9) * (F.col("l_partkey") % 9 + 1), "0E+00"),
        f"SELECT {_KEYS}, (l_partkey % 9 + 1) || 'E+0' || CAST(l_quantity % 9 AS INTEGER) AS shown FROM lineitem",
    ),
    "fmt_fraction": (
        lambda s, d: _shown(s, d, F.floor(F.col("quantity")) + (F.col("l_partkey") % 3 + 1) / 4, "# ?/?"),
        f"""SELECT {_KEYS}, CAST(floor(l_quantity) AS INTEGER) || ' ' || (['1/4', '1/2', '3/4'])[CAST(l_partkey % 3 + 1 AS INTEGER)] AS shown FROM lineitem""",
    ),
    "fmt_general": (
        lambda s, d: _shown(s, d, F.col("l_partkey") / 4, "General"),
        f"""SELECT {_KEYS}, (l_partkey // 4) || (['', '.25', '.5', '.75'])[CAST(l_partkey % 4 + 1 AS INTEGER)] AS shown FROM lineitem""",
    ),
    "fmt_date": (
        lambda s, d: read(s, d, "orders").select(
            "o_orderkey", numfmt.format_column(F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date")), F.lit("yyyy-mm-dd")).alias("shown")
        ),
        "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS shown FROM orders",
    ),
    "fmt_date_words": (
        lambda s, d: read(s, d, "orders").select(
            "o_orderkey", numfmt.format_column(F.datediff(F.col("o_orderdate"), F.lit("1899-12-30").cast("date")), F.lit("dddd, d mmm yy")).alias("shown")
        ),
        "SELECT o_orderkey, strftime(o_orderdate, '%A, %-d %b %y') AS shown FROM orders",
    ),
    "fmt_elapsed": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", numfmt.format_column((F.col("o_orderkey") % 200000) / 86400, F.lit("[h]:mm:ss")).alias("shown")),
        """WITH v AS (SELECT o_orderkey, o_orderkey % 200000 AS t FROM orders)
           SELECT o_orderkey, (t // 3600) || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((t % 60)::VARCHAR, 2, '0') AS shown FROM v""",
    ),
    "fmt_time": (
        lambda s, d: read(s, d, "orders").select("o_orderkey", numfmt.format_column((F.col("o_orderkey") * 61 % 86400) / 86400, F.lit("h:mm AM/PM")).alias("shown")),
        """WITH v AS (SELECT o_orderkey, o_orderkey * 61 % 86400 AS t FROM orders)
           SELECT o_orderkey, CASE WHEN t // 3600 % 12 = 0 THEN 12 ELSE t // 3600 % 12 END || ':' || lpad((t // 60 % 60)::VARCHAR, 2, '0')
                  || CASE WHEN t < 43200 THEN ' AM' ELSE ' PM' END AS shown FROM v""",
    ),
    "fmt_codes": (_by_code, None),
}
