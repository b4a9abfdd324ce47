"""Checks of Egyptian and international identifiers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitara.functions.text import let

# Weights of the national id's check digit.
NID_WEIGHTS = (2, 7, 6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)
# Governorate codes with a name; 01 to 35 and 88 are valid.
GOVERNORATES = {
    "01": "Cairo", "02": "Alexandria", "03": "Port Said", "04": "Suez", "11": "Damietta", "12": "Dakahlia", "13": "Sharqia",
    "14": "Qalyubia", "15": "Kafr El Sheikh", "16": "Gharbia", "17": "Monufia", "18": "Beheira", "19": "Ismailia", "21": "Giza",
    "22": "Beni Suef", "23": "Fayoum", "24": "Minya", "25": "Asyut", "26": "Sohag", "27": "Qena", "28": "Aswan", "29": "Luxor",
    "31": "Red Sea", "32": "New Valley", "33": "Matrouh", "34": "North Sinai", "35": "South Sinai", "88": "Born abroad",
}
OLDEST_YEARS = 120
# Fixed value: what may part the digits and letters of a mobile number, an IBAN or a tax id.
SEPARATORS = r"(?U)[\s\-().]"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def nid_check_digit(nid: Column) -> Column:
    """Expected check digit of the first 13 digits; null where the rule gives none."""
    weights = F.array(*[F.lit(w) for w in NID_WEIGHTS])
    total = F.aggregate(F.zip_with(F.slice(_chars(nid), 1, 13), weights, lambda d, w: d.try_cast("int") * w), F.lit(0), lambda s, x: s + x)
    return let(F.pmod(11 - F.pmod(total, F.lit(11)), F.lit(11)), lambda check: F.when(check != 10, check))


def parse_nid(nid: Column, today: Column | None = None) -> Column:
    """struct(birth_date, governorate_code, governorate, serial, check_digit, female, checksum_ok); null if no national id."""
    return let(nid, lambda n: _parse_nid(n, F.current_date() if today is None else today))


def _parse_nid(nid: Column, today: Column) -> Column:
    century = F.substring(nid, 1, 1)
    year = F.concat(F.when(century == "2", "19").when(century == "3", "20"), F.substring(nid, 2, 2))
    code = F.substring(nid, 8, 2)
    valid_code = code.between("01", "35") | (code == "88")
    check = F.substring(nid, 14, 1).cast("int")

    def fields(born: Column) -> Column:
        known = F.coalesce(*[F.when(code == k, F.lit(name)) for k, name in GOVERNORATES.items()], F.lit(None).cast("string"))
        made = F.struct(
            born.alias("birth_date"),
            code.alias("governorate_code"),
            known.alias("governorate"),
            F.substring(nid, 10, 4).alias("serial"),
            check.alias("check_digit"),
            (F.pmod(F.substring(nid, 13, 1).cast("int"), F.lit(2)) == 0).alias("female"),
            F.coalesce(nid_check_digit(nid) == check, F.lit(False)).alias("checksum_ok"),
        )
        return F.when(born.isNotNull() & (born <= today) & (F.year(born) >= F.year(today) - OLDEST_YEARS), made)

    born = F.try_to_date(F.concat(year, F.substring(nid, 4, 4)), "yyyyMMdd")
    return F.when(nid.rlike("^[0-9]{14}$") & valid_code, let(born, fields))


def nid_score(parsed: Column) -> Column:
    return F.when(parsed["checksum_ok"], 1.0).otherwise(0.85)


def mobile_e164(value: Column) -> Column:
    """'+201' and nine digits for an Egyptian mobile number in any usual form, else null."""

    def local(bare: Column) -> Column:
        return F.when(bare.startswith("0020"), F.substring(bare, 5, 99)).when(bare.startswith("20") & (F.length(bare) == 12), F.substring(bare, 3, 99)).when(bare.startswith("0"), F.substring(bare, 2, 99)).otherwise(bare)

    found = let(F.regexp_replace(F.regexp_replace(value, SEPARATORS, ""), r"^\+", ""), local)
    return let(found, lambda x: F.when(x.rlike("^1[0125][0-9]{8}$"), F.concat(F.lit("+20"), x)))


def _letters_to_numbers(value: Column) -> Column:
    """Digits stay, A to Z become 10 to 35."""
    code = lambda c: F.when(c.between("0", "9"), c).otherwise((F.ascii(c) - 55).cast("string"))
    return F.array_join(F.transform(_chars(value), code), "")


def mod97(numeric: Column) -> Column:
    return F.aggregate(_chars(numeric), F.lit(0).cast("long"), lambda a, d: F.pmod(a * 10 + d.cast("long"), F.lit(97).cast("long")))


def iban_remainder(iban: Column) -> Column:
    """Remainder mod 97 of an IBAN with its head moved to the end: 1 for a valid one."""
    return mod97(_letters_to_numbers(F.concat(F.substring(iban, 5, 99), F.substring(iban, 1, 4))))


def bare_iban(value: Column) -> Column:
    return F.upper(F.regexp_replace(value, SEPARATORS, ""))


def eg_iban_valid(value: Column) -> Column:
    return let(bare_iban(value), lambda iban: F.when(iban.rlike(r"^EG[0-9]{2}[A-Z0-9]{25}$"), iban_remainder(iban) == 1).otherwise(F.lit(False)))


def iban_valid(value: Column) -> Column:
    return let(bare_iban(value), lambda iban: F.when(iban.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), iban_remainder(iban) == 1).otherwise(F.lit(False)))


def iban_check_digits(country: Column, bban: Column) -> Column:
    """The two check digits of a country and its account number."""
    return F.lpad((F.lit(98) - mod97(_letters_to_numbers(F.concat(bban, country, F.lit("00"))))).cast("string"), 2, "0")


def tax_id_plausible(value: Column) -> Column:
    """Nine digits without their separators, not all the same."""
    return let(F.regexp_replace(value, SEPARATORS, ""), lambda bare: bare.rlike("^[0-9]{9}$") & (F.size(F.array_distinct(_chars(bare))) > 1))


def luhn_ok(value: Column) -> Column:
    """Luhn's checksum over the digits of a value with 13 to 19 of them."""
    return let(digits(value), _luhn)


def _luhn(bare: Column) -> Column:
    places = F.zip_with(F.reverse(_chars(bare)), F.sequence(F.lit(0), F.lit(18)), lambda d, i: F.struct(d.cast("int").alias("d"), i.alias("i")))
    double = lambda x: x["d"] * 2 - F.when(x["d"] > 4, 9).otherwise(0)
    total = F.aggregate(F.filter(places, lambda x: x["d"].isNotNull()), F.lit(0), lambda s, x: s + F.when(F.pmod(x["i"], F.lit(2)) == 1, double(x)).otherwise(x["d"]))
    return F.when(F.length(bare).between(13, 19), F.pmod(total, F.lit(10)) == 0).otherwise(F.lit(False))
