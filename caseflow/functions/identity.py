"""Ecuadorian identity numbers (cédula and RUC) as native Column expressions.

No UDF: every digit is read with ``ascii(substring(...)) - 48`` behind a
regex guard, so the whole check stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace class of the service's regex engine (``\s``
# there includes the Unicode spaces below), and the RUC check weights.
JS_SPACE_CLASS = "\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}"
PUBLIC_COMPANY_WEIGHTS = [3, 2, 7, 6, 5, 4, 3, 2]       # third digit 6, check digit in position 9
PRIVATE_COMPANY_WEIGHTS = [4, 3, 2, 7, 6, 5, 4, 3, 2]   # third digit 9, check digit in position 10


def strip_separators(col: Column) -> Column:
    """Remove whitespace (Unicode-aware) and hyphens."""
    return F.regexp_replace(col, f"[{JS_SPACE_CLASS}-]", "")


def strip_non_digits(col: Column) -> Column:
    return F.regexp_replace(col, "[^0-9]", "")


def _d(s: Column, i) -> Column:
    """Digit at zero-based position ``i`` (an int or an int Column)."""
    pos = (i + 1) if isinstance(i, Column) else F.lit(i + 1)
    return F.ascii(F.substr(s, pos, F.lit(1))) - 48


def _weighted(s: Column, weights: list[int]) -> Column:
    """sum(d[i] * w[i]) as one higher-order expression: the identifier is
    referenced once, so plans stay small even when Catalyst inlines it."""
    w = F.array(*[F.lit(x) for x in weights])
    return F.aggregate(F.sequence(F.lit(0), F.lit(len(weights) - 1)), F.lit(0),
                       lambda acc, i: acc + _d(s, i) * F.element_at(w, i + 1))


def _cedula_sum(s: Column) -> Column:
    def term(acc, i):
        p = _d(s, i) * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))
        return acc + F.when(p > 9, p - 9).otherwise(p)
    return F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), term)


def _province(s: Column) -> Column:
    return F.substr(s, F.lit(1), F.lit(2)).try_cast("int")


def is_cedula(clean: Column) -> Column:
    """10 digits, province 01-24, third digit <= 5, modulo-10 check digit."""
    check = (10 - _cedula_sum(clean) % 10) % 10
    prov = _province(clean)
    ok = prov.between(1, 24) & (_d(clean, 2) <= 5) & (check == _d(clean, 9))
    return F.coalesce(F.when(clean.rlike("^[0-9]{10}$"), ok), F.lit(False))


def _mod11(clean: Column, weights: list[int], pos: int) -> Column:
    r = 11 - _weighted(clean, weights) % 11
    return F.when(r == 11, F.lit(0)).otherwise(r) == _d(clean, pos)


def is_ruc(clean: Column) -> Column:
    """13-digit taxpayer number: natural person (third <= 5), public (6) or
    private (9) company rules."""
    prov = _province(clean)
    third = _d(clean, 2)
    prov_ok = prov.between(1, 24) | (prov == 30)
    natural = (third <= 5) & is_cedula(F.substr(clean, F.lit(1), F.lit(10))) & clean.endswith("001")
    public = (third == 6) & _mod11(clean, PUBLIC_COMPANY_WEIGHTS, 8) & clean.endswith("0001")
    private = (third == 9) & _mod11(clean, PRIVATE_COMPANY_WEIGHTS, 9) & clean.endswith("001")
    return F.coalesce(F.when(clean.rlike("^[0-9]{13}$"), prov_ok & (natural | public | private)), F.lit(False))


def identifier_type(clean: Column) -> Column:
    """'cedula', 'ruc' or null.  The identifier enters one lambda once, so
    when Catalyst inlines this column into filters or later projections it
    copies one reference, not one per digit."""
    return F.element_at(
        F.transform(F.array(clean), lambda s: F.when(is_cedula(s), "cedula").when(is_ruc(s), "ruc")), 1)


# ----------------------------------------------------------------------------- SQL form
# The same rules as SQL text over a named column: one JVM call builds the
# whole classification (used by the whole-table job).


def _dig(v: str, pos) -> str:
    return f"(ascii(substr({v}, {pos}, 1)) - 48)"


def _cedula_sql(v: str) -> str:
    p = f"({_dig(v, 'i + 1')} * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)"
    total = f"aggregate(sequence(0, 8), 0, (acc, i) -> acc + CASE WHEN {p} > 9 THEN {p} - 9 ELSE {p} END)"
    return (f"coalesce(CASE WHEN {v} RLIKE '^[0-9]{{10}}$' THEN "
            f"(try_cast(substr({v}, 1, 2) AS INT) BETWEEN 1 AND 24) AND {_dig(v, 3)} <= 5 "
            f"AND (10 - {total} % 10) % 10 = {_dig(v, 10)} END, false)")


def _mod11_sql(v: str, weights: list[int], pos: int) -> str:
    w = ", ".join(str(x) for x in weights)
    r = (f"(11 - aggregate(sequence(0, {len(weights) - 1}), 0, "
         f"(acc, i) -> acc + {_dig(v, 'i + 1')} * element_at(array({w}), i + 1)) % 11)")
    return f"(CASE WHEN {r} = 11 THEN 0 ELSE {r} END) = {_dig(v, pos + 1)}"


def _ruc_sql(v: str) -> str:
    prov = f"try_cast(substr({v}, 1, 2) AS INT)"
    third = _dig(v, 3)
    return (f"coalesce(CASE WHEN {v} RLIKE '^[0-9]{{13}}$' THEN "
            f"({prov} BETWEEN 1 AND 24 OR {prov} = 30) AND ("
            f"({third} <= 5 AND {_cedula_sql(f'substr({v}, 1, 10)')} AND endswith({v}, '001')) "
            f"OR ({third} = 6 AND {_mod11_sql(v, PUBLIC_COMPANY_WEIGHTS, 8)} AND endswith({v}, '0001')) "
            f"OR ({third} = 9 AND {_mod11_sql(v, PRIVATE_COMPANY_WEIGHTS, 9)} AND endswith({v}, '001'))) END, false)")


def identifier_type_sql(column: str) -> Column:
    """identifier_type over the column named ``column``, as one expression."""
    q = "`" + column.replace("`", "``") + "`"
    return F.expr(f"element_at(transform(array({q}), s -> CASE WHEN {_cedula_sql('s')} THEN 'cedula' "
                  f"WHEN {_ruc_sql('s')} THEN 'ruc' END), 1)")
