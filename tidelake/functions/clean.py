"""Cleaning of text columns; what can't be read becomes null and never fails, with ANSI mode on or off."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# The federal states by code, and letters with their plain forms.
STATES = {
    "AC": "Acre", "AL": "Alagoas", "AP": "Amapá", "AM": "Amazonas", "BA": "Bahia", "CE": "Ceará", "DF": "Distrito Federal",
    "ES": "Espírito Santo", "GO": "Goiás", "MA": "Maranhão", "MT": "Mato Grosso", "MS": "Mato Grosso do Sul", "MG": "Minas Gerais",
    "PA": "Pará", "PB": "Paraíba", "PR": "Paraná", "PE": "Pernambuco", "PI": "Piauí", "RJ": "Rio de Janeiro",
    "RN": "Rio Grande do Norte", "RS": "Rio Grande do Sul", "RO": "Rondônia", "RR": "Roraima", "SC": "Santa Catarina",
    "SP": "São Paulo", "SE": "Sergipe", "TO": "Tocantins",
}
ACCENTED = "áàâãäéèêëíìîïóòôõöúùûüçÁÀÂÃÄÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇ"
PLAIN = "aaaaaeeeeiiiiooooouuuucAAAAAEEEEIIIIOOOOOUUUUC"
ISO_TIME, LOCAL_TIME, PLAIN_TIME = "yyyy-MM-dd'T'HH:mm:ss'Z'", "dd/MM/yyyy HH:mm:ss", "yyyy-MM-dd HH:mm:ss"


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fold_accents(c: Column | str) -> Column:
    return F.translate(column(c), ACCENTED, PLAIN)


def normalize_code(c: Column | str, names: Mapping[str, str]) -> Column:
    """The code for a code or a full name in any case, accents and outer spaces aside; else null. The names are a literal
    map of the plan, so nothing is joined."""
    text = F.upper(fold_accents(F.trim(column(c))))
    plain = str.maketrans(ACCENTED, PLAIN)
    known = {k: k for k in names} | {v.translate(plain).upper(): k for k, v in names.items()}
    return F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), text)


def normalize_state(c: Column | str) -> Column:
    return normalize_code(c, STATES)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(F.trim(column(c)), F.lit(""))


def parse_first(c: Column | str, *formats: str) -> Column:
    """The timestamp by the first format that reads the text, or null."""
    return F.coalesce(*[F.try_to_timestamp(column(c), F.lit(f)) for f in formats])


def lenient_int(c: Column | str) -> Column:
    """Text as an int as a cast outside ANSI mode reads it: a fraction is cut off; exponents, other text and values that
    don't fit give null."""
    text = F.trim(column(c))
    number = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$")
    return F.when(number, text.try_cast("decimal(38,10)").try_cast("int"))


def rule(condition: Column) -> Column:
    """A condition in which null means false."""
    return F.coalesce(condition, F.lit(False))
