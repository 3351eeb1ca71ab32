"""Fact types, stored forms and search keys of identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alnum_upper, collapse_spaces, digits_only

# Fact types with their titles.
TITLES = {
    "phone": "Телефон",
    "email": "Электронная почта",
    "address": "Адрес",
    "workplace": "Место работы",
    "position": "Должность",
    "vehicle": "Автомобиль",
    "license_plate": "Госномер",
    "vin": "VIN",
    "bank_account": "Банковский счёт",
    "bank_card": "Банковская карта",
    "document": "Документ",
    "inn": "ИНН",
    "snils": "СНИЛС",
    "website": "Сайт",
    "social_account": "Аккаунт в соцсети",
    "other": "Прочее",
}
# Types by the way their values are written down.
DIGIT_TYPES = ("bank_account", "bank_card", "inn", "snils")
CODE_TYPES = ("vin", "document")
LOWER_TYPES = ("website", "social_account")
CODE_LIKE = ("phone", *DIGIT_TYPES, *CODE_TYPES, "license_plate")
# Letters of number plates, and formats that decide a type.
PLATE_CYRILLIC, PLATE_LATIN = "АВЕКМНОРСТУХ", "ABEKMHOPCTYX"
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
SNILS = r"^\d{3}-\d{3}-\d{3}[ -]\d{2}$"
PLATE = rf"(?iu)^[{PLATE_CYRILLIC}{PLATE_LATIN}]\s?\d{{3}}\s?[{PLATE_CYRILLIC}{PLATE_LATIN}]{{2}}\s?\d{{2,3}}$"
VIN = r"(?i)^(?=.*\d)(?=.*[A-HJ-NPR-Z])[A-HJ-NPR-Z0-9]{17}$"
LONGEST_KEY = 400


def normalize_plate(x: Column) -> Column:
    return F.translate(alnum_upper(x), PLATE_CYRILLIC, PLATE_LATIN)


def title(type_: Column) -> Column:
    names = F.create_map(*[F.lit(v) for pair in TITLES.items() for v in pair])
    return F.coalesce(names[F.lower(type_)], type_, F.lit("—"))


def _some(x: Column) -> Column:
    return F.when(F.length(x) > 0, x)


def stored_form(type_: Column, value: Column) -> Column:
    """The normalised value kept with a fact, or null where its type has none."""
    v, digits = F.trim(value), digits_only(value)
    phone = F.when(F.length(digits) >= 5, F.when(v.startswith("+"), F.concat(F.lit("+"), digits)).otherwise(digits))
    mail = F.lower(v)
    return F.when(F.length(v) > 0,
        F.when(type_ == "phone", phone)
        .when(type_ == "email", F.when(mail.rlike(EMAIL), mail))
        .when(type_.isin(*DIGIT_TYPES), _some(digits))
        .when(type_.isin(*CODE_TYPES), _some(alnum_upper(v)))
        .when(type_ == "license_plate", _some(normalize_plate(v)))
        .when(type_.isin(*LOWER_TYPES), mail),
    )


def search_key(type_: Column, value: Column) -> Column:
    """The key of the value index: phones without their plus sign; null if empty or too long."""
    v, digits = F.trim(value), digits_only(value)
    key = (
        F.when(type_ == "phone", F.when(F.length(digits) >= 5, digits))
        .when(type_.isin("email", *LOWER_TYPES), F.lower(v))
        .when(type_.isin(*DIGIT_TYPES), digits)
        .when(type_.isin(*CODE_TYPES), alnum_upper(v))
        .when(type_ == "license_plate", normalize_plate(v))
        .otherwise(F.translate(F.lower(collapse_spaces(value)), "ё", "е"))
    )
    return F.when((F.length(v) > 0) & (F.length(key) > 0) & (F.length(key) <= LONGEST_KEY), key)


def search_key_any(value: Column) -> Column:
    """The key of an identifier whose type is not said."""
    digits = digits_only(value)
    plain = ~value.rlike(r"\p{L}") & (F.length(digits) >= 5)
    return F.when(F.length(F.trim(value)) > 0, F.when(plain, digits).when(F.contains(value, F.lit("@")), F.lower(F.trim(value))).otherwise(alnum_upper(value)))


def corrected_type(type_: Column, value: Column, column_name: Column) -> Column:
    """The type that the value's format decides, unless the column's name speaks against it."""
    v, name = F.trim(value), F.lower(F.coalesce(column_name, F.lit("")))
    digits = digits_only(v)
    says = lambda *names: F.greatest(*[F.contains(name, F.lit(n)) for n in names])
    only_digits = (digits == v) & F.length(v).isin(10, 12)
    return (
        F.when(F.length(F.coalesce(v, F.lit(""))) == 0, type_)
        .when((type_ == "snils") & ~v.rlike(SNILS) & only_digits & ~says("снилс", "snils"), F.lit("inn"))
        .when((type_ == "inn") & v.rlike(SNILS) & ~says("инн", "inn"), F.lit("snils"))
        .when(type_.isin("vehicle", "other", "document") & v.rlike(PLATE), F.lit("license_plate"))
        .when(type_.isin("vehicle", "other", "document", "license_plate") & v.rlike(VIN), F.lit("vin"))
        .otherwise(type_)
    )


def known_type(type_: Column) -> Column:
    t = F.lower(F.trim(type_))
    return F.when(t.isin(*TITLES), t).otherwise(F.lit("other"))
