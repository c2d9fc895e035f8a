"""Check digits, amounts, dates, value normalisation and document validators, as Columns.

Fields of a document are a ``map<string,string>``; items an ``array<map<string,string>>``.  A validator yields
``array<struct<code, severity, field>>``.  The current date is a parameter, never the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docengine.functions.text import once

#: Field names, issue codes and weights below.
NO_ISSUES = "array<struct<code:string,severity:string,field:string>>"


def only_digits(value: Column) -> Column:
    return F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^0-9]", "")


def _digit(s: Column, i: Column | int) -> Column:
    at = F.lit(i) if isinstance(i, int) else i
    return F.ascii(F.substring(s, at, F.lit(1))) - 48


def _weighted(s: Column, weights: list[int]) -> Column:
    digits = F.slice(F.regexp_extract_all(s, F.lit("([0-9])")), 1, len(weights))
    return F.aggregate(F.zip_with(digits, F.array(*[F.lit(w) for w in weights]), lambda d, w: d.cast("int") * w), F.lit(0), lambda a, x: a + x)


def _mod11(total: Column) -> Column:
    rest = total % 11
    return F.when(rest < 2, 0).otherwise(11 - rest)


def nfe_check_digit(key43: Column) -> Column:
    """Weights 2 to 9 repeat from the right over 43 digits."""
    return _mod11(_weighted(key43, [2 + (42 - i) % 8 for i in range(43)]))


def is_valid_nfe_key(value: Column) -> Column:
    return once(only_digits(value), lambda k: F.when(F.length(k) == 44, nfe_check_digit(k) == _digit(k, 44)).otherwise(False))


def _falling(n: int) -> list[int]:
    """Weights that end in 2 and rise to the left up to 9, then start again."""
    return [2 + (n - 1 - i) % 8 for i in range(n)]


def is_valid_cnpj(value: Column) -> Column:

    def check(c: Column) -> Column:
        good = (_mod11(_weighted(c, _falling(12))) == _digit(c, 13)) & (_mod11(_weighted(c, _falling(13))) == _digit(c, 14))
        return F.when((F.length(c) == 14) & ~F.regexp_like(c, F.lit(r"^(\d)\1*$")), good).otherwise(False)

    return once(only_digits(value), check)


def is_valid_cpf(value: Column) -> Column:

    def check(c: Column) -> Column:
        rest = lambda n: _weighted(c, list(range(n + 1, 1, -1))) * 10 % 11 % 10
        return F.when((F.length(c) == 11) & ~F.regexp_like(c, F.lit(r"^(\d)\1*$")), (rest(9) == _digit(c, 10)) & (rest(10) == _digit(c, 11))).otherwise(False)

    return once(only_digits(value), check)


def parse_amount(value: Column) -> Column:
    """Amounts in either notation, or null."""

    def plain(s: Column) -> Column:
        comma, dot = F.length(s) - F.locate(",", F.reverse(s)), F.length(s) - F.locate(".", F.reverse(s))
        comma, dot = F.when(F.contains(s, F.lit(",")), comma).otherwise(-1), F.when(F.contains(s, F.lit(".")), dot).otherwise(-1)
        no_dots = F.replace(s, F.lit("."), F.lit(""))
        decimal = F.regexp_replace(no_dots, "^([^,]*),", "$1.")
        return F.when((comma >= 0) & (comma > dot), decimal).when(F.regexp_like(s, F.lit(r"^-?\d{1,3}(\.\d{3})+$")), no_dots).otherwise(F.replace(s, F.lit(","), F.lit("")))

    signs = F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"[^0-9,.\-]", "")
    return once(once(signs, plain), lambda p: F.when(F.regexp_like(p, F.lit(r"^-?(\d+\.?\d*|\.\d+)$")), p.try_cast("double")))


def parse_date(value: Column) -> Column:
    """ISO prefixes as they are; day/month/year in ISO order if month and day can be; else null."""
    iso, other = r"^(\d{4}-\d{2}-\d{2})", r"^(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})"

    def date(s: Column) -> Column:
        return F.when(F.regexp_like(s, F.lit(iso)), F.regexp_extract(s, iso, 1)).otherwise(once(F.array(*[F.regexp_extract(s, other, i) for i in (3, 2, 1)]), turned))

    def turned(p: Column) -> Column:
        year = F.when(F.length(p[0]) == 2, F.concat(F.lit("20"), p[0])).otherwise(p[0])
        fits = p[1].try_cast("int").between(1, 12) & p[2].try_cast("int").between(1, 31)
        return F.when(fits, F.concat_ws("-", year, F.lpad(p[1], 2, "0"), F.lpad(p[2], 2, "0")))

    return once(F.trim(F.coalesce(value.cast("string"), F.lit(""))), date)


def number_text(x: Column) -> Column:
    """A rounded amount without trailing zeros."""
    cents = F.floor(x * 100 + 0.5).cast("decimal(20,0)")
    return F.regexp_replace(F.regexp_replace((cents / 100).cast("decimal(20,2)").cast("string"), r"0+$", ""), r"\.$", "")


def normalize_value(value: Column) -> Column:
    """Dates in ISO, long identifiers as digits, amounts as plain numbers, other values as folded space."""

    def normal(s: Column) -> Column:
        date = F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d{2}-\d{2}|^\d{1,2}[/-]\d{1,2}[/-]\d{2,4}$")), parse_date(s))
        digits = F.when(F.regexp_like(s, F.lit(r"^[\d.\-/\s]+$")), once(only_digits(s), lambda d: F.when(F.length(d) >= 11, d)))
        amount = F.when(F.regexp_like(s, F.lit(r"^R?\$?\s*-?\d[\d.,]*$")), parse_amount(s))
        return F.when(s == "", "").otherwise(F.coalesce(date, digits, number_text(amount), F.lower(F.regexp_replace(s, r"\s+", " "))))

    return once(F.trim(F.coalesce(value.cast("string"), F.lit(""))), normal)


def field(fields: Column, *names: str) -> Column:
    """The first of the names that has a value."""
    return F.coalesce(*[F.try_element_at(fields, F.lit(n)) for n in names])


def _blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def _issue(code: str, severity: str, name: str | Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (F.lit(name) if isinstance(name, str) else name).alias("field"))


def _issues(*cases: tuple[Column, Column]) -> Column:
    """The issues whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, i) for c, i in cases]), lambda x: x.isNotNull())


def nfe_key(fields: Column, **_: object) -> Column:
    key = field(fields, "chaveAcesso", "chave", "accessKey")
    wrong = F.when(_blank(key), _issue("nfe_key_missing", "warning", "chaveAcesso")).when(F.length(only_digits(key)) != 44, _issue("nfe_key_length", "error", "chaveAcesso")).when(~is_valid_nfe_key(key), _issue("nfe_key_dv", "error", "chaveAcesso"))
    return F.filter(F.array(wrong), lambda x: x.isNotNull())


def _per_field(names: list[str], wrong: Callable[[Column], Column], code: str, severity: str = "error") -> Callable[..., Column]:
    def check(fields: Column, **_: object) -> Column:
        return _issues(*[(~_blank(field(fields, n)) & wrong(field(fields, n)), _issue(code, severity, n)) for n in names])

    return check


def items_total(items: Column) -> Column:
    """Sum of items: their total, else quantity (1 if missing) times unit price."""

    def one(it: Column) -> Column:
        total, unit = parse_amount(field(it, "valorTotal", "total", "valor")), parse_amount(field(it, "valorUnitario", "precoUnitario"))
        return F.coalesce(total, F.coalesce(parse_amount(field(it, "quantidade", "qtd")), F.lit(1.0)) * unit, F.lit(0.0))

    return F.aggregate(F.transform(items, one), F.lit(0.0), lambda a, x: a + x)


def items_sum(fields: Column, items: Column | None = None, **_: object) -> Column:
    if items is None:
        return F.array().cast(NO_ISSUES)
    total = parse_amount(field(fields, "valorTotal", "total", "valor"))
    off = items.isNotNull() & total.isNotNull() & (F.round(F.abs(items_total(items) - total), 6) > 0.01)
    return _issues((off, _issue("soma_itens", "error", "valorTotal")))


def dates(fields: Column, as_of: Column | None = None, **_: object) -> Column:
    raw, raw_due = field(fields, "dataEmissao", "emissao", "data"), field(fields, "dataVencimento", "vencimento")
    given, due = parse_date(raw), parse_date(raw_due)
    tomorrow = F.date_format(F.date_add(as_of if as_of is not None else F.lit("9999-12-30").cast("date"), 1), "yyyy-MM-dd")
    return _issues(
        ((F.coalesce(raw, F.lit("")) != "") & given.isNull(), _issue("data_invalida", "warning", "dataEmissao")),
        ((F.coalesce(raw_due, F.lit("")) != "") & due.isNull(), _issue("data_invalida", "warning", "dataVencimento")),
        (due < given, _issue("vencimento_antes_emissao", "error", "dataVencimento")),
        (given > tomorrow, _issue("data_futura", "warning", "dataEmissao")),
    )


def required(fields: Column, doc_type: Column | None = None, **_: object) -> Column:
    nfe = F.coalesce(doc_type == "nfe", F.lit(False)) if doc_type is not None else F.lit(False)
    return _issues(
        (nfe & _blank(field(fields, "numero")), _issue("campo_faltando", "warning", "numero")),
        (_blank(field(fields, "valorTotal")), _issue("campo_faltando", "warning", "valorTotal")),
        (nfe & _blank(field(fields, "dataEmissao")), _issue("campo_faltando", "warning", "dataEmissao")),
    )


def positive_amounts(fields: Column, **_: object) -> Column:
    def case(n: str) -> Column:
        raw = field(fields, n)
        wrong = once(parse_amount(raw), lambda v: F.when(v.isNull(), _issue("valor_ilegivel", "error", n)).when(v < 0, _issue("valor_negativo", "warning", n)))
        return F.when(~_blank(raw), wrong)

    return F.filter(F.array(*[case(n) for n in ("valorTotal", "total", "valor", "valorLiquido")]), lambda x: x.isNotNull())


VALIDATORS: dict[str, Callable[..., Column]] = {
    "nfeKey": nfe_key,
    "cnpj": _per_field(["cnpjEmitente", "cnpjDestinatario", "cnpj", "cnpjPrestador", "cnpjTomador"], lambda v: ~is_valid_cnpj(v), "cnpj_invalido"),
    "cpf": _per_field(["cpf", "cpfDestinatario", "cpfTomador"], lambda v: ~is_valid_cpf(v), "cpf_invalido"),
    "itemsSum": items_sum,
    "dates": dates,
    "required": required,
    "positiveAmounts": positive_amounts,
}


def run_validators(names: list[str], fields: Column, items: Column | None = None, doc_type: Column | None = None, as_of: Column | None = None) -> Column:
    """All issues in the order of the names; an unknown name is an issue of severity info."""
    found = [VALIDATORS[n](fields, items=items, doc_type=doc_type, as_of=as_of) if n in VALIDATORS else F.array(_issue("validador_desconhecido", "info", n)) for n in names]
    return F.flatten(F.array(*found)) if found else F.array().cast(NO_ISSUES)


def is_ok(issues: Column) -> Column:
    return ~F.exists(issues, lambda i: i["severity"] == "error")
