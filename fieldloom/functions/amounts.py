"""Amounts: parsing, subtotal, reconciliation, derived person type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldloom.functions.binding import let
from fieldloom.functions.checks import LEGAL, NATURAL, filled, is_legal_person_name, person_type

MONEY = "decimal(18,2)"


def to_amount(value: Column) -> Column:
    """Printed amount as a decimal; absent or unreadable counts as zero."""
    return F.coalesce(F.replace(value, F.lit(","), F.lit("")).try_cast(MONEY), F.lit(0).cast(MONEY))


def subtotal(net: Column, discount: Column, surcharge: Column, fees: Column) -> Column:
    """Net - discount + surcharge + fees as printed money; NULL without a net amount."""
    total = to_amount(net) - to_amount(discount) + to_amount(surcharge) + to_amount(fees)
    return F.when(filled(net), F.format_number(total, 2))


def reconcile(computed: Column, printed: Column, total: Column, tax: Column) -> Column:
    """Pick a subtotal and say why.

    ``checked``   the computed value agrees with total - tax within one cent
    ``printed``   it does not, and the document prints one
    ``unchecked`` it does not, and there is nothing else
    """

    def choose(made: Column) -> Column:
        gap = F.abs(to_amount(made) - (to_amount(total) - to_amount(tax)))
        agrees = F.coalesce(filled(made) & filled(total) & filled(tax) & (gap <= F.lit("0.01").cast(MONEY)), F.lit(False))
        return let(agrees, lambda ok: F.struct(
            F.when(ok, made).when(filled(printed), printed).otherwise(made).alias("value"),
            F.when(ok, "checked").when(filled(printed), "printed").when(filled(made), "unchecked").alias("status"),
        ))

    return let(computed, choose)


def discounted_net(text: Column, net: Column, discounted: Column, marker: str) -> Column:
    """The discounted net amount when the text lists its discounts one by one."""
    return F.when(F.rlike(text, F.lit(marker)), F.coalesce(discounted, net)).otherwise(net)


def derive_person_type(existing: Column, tax_id: Column, name: Column, output: str = "label") -> Column:
    """Existing value, else by tax id, else by company form in the name.

    ``output="code"`` gives 0/1 and uses the tax id alone.
    """
    if output == "code":
        kind = person_type(F.regexp_replace(tax_id, "[ -]", ""))
        derived = F.when(kind == NATURAL, F.lit("0")).when(kind == LEGAL, F.lit("1"))
    else:
        derived = F.coalesce(person_type(tax_id), F.when(is_legal_person_name(name), F.lit(LEGAL)))
    return F.coalesce(existing, derived)


def person_label(value: Column) -> Column:
    """0/1 as readable text, anything else unchanged."""
    v = F.trim(value)
    return F.when(v == "0", F.lit(NATURAL)).when(v == "1", F.lit(LEGAL)).otherwise(v)


# ---- fixed values: Spanish month names
MONTHS = {"ENE": "01", "FEB": "02", "MAR": "03", "ABR": "04", "MAY": "05", "JUN": "06",
          "JUL": "07", "AGO": "08", "SEP": "09", "OCT": "10", "NOV": "11", "DIC": "12"}
# ---- end of fixed values


def to_date(value: Column) -> Column:
    """Typed view of a printed date: dd/mm/yyyy, dd-mm-yyyy, yyyy-mm-dd, dd/Mon/yyyy."""
    text = F.upper(value)
    for name, number in MONTHS.items():
        text = F.regexp_replace(text, f"(?<=[/-]){name}(?=[/-])", number)
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in ("dd/MM/yyyy", "dd-MM-yyyy", "yyyy-MM-dd")]
    return F.coalesce(*tries).cast("date")


def to_money(value: Column) -> Column:
    """Typed view of a printed amount, NULL when unreadable."""
    return F.regexp_replace(value, "[$, ]", "").try_cast(MONEY)
