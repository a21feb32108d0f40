"""Dates as period numbers, catalogue codes, procedure groups, subsectors."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession, DataFrame
from pyspark.sql import functions as F

# fixed values: class codes of each subsector, and the prefix of medicines
SUBSECTOR_CLASSES = {
    1: (
        721214, 851615, 721211, 801315, 721015, 721540, 761115, 721536, 721515, 811123, 731521, 781815, 761015,
        721210,
    ),
    2: (851218, 851015, 701716),
    3: (851017, 801015, 801017, 811017),
    4: (
        921015, 911116, 781018, 761220, 811120, 831217, 781118, 771116, 781022, 831115, 831116, 841115, 821016,
        821215, 821017, 841316, 841315, 821115, 811118, 931316, 761222,
    ),
    5: (121419, 123522),
    6: (
        421322, 421426, 421415, 421317, 421425, 422717, 411161, 423115, 422017, 422916, 422722, 421819, 422220,
        422951, 423215, 422935, 421616, 421922, 422949, 461815, 421316, 423122, 461820, 411029, 411035, 411158,
        421321, 422315, 422719, 422954, 411048, 411049, 422215, 411162, 422846, 411160, 421820,
    ),
    7: (
        422318, 551015, 551218, 151015, 501316, 501927, 141117, 531316, 471318, 501115, 501819, 502211, 101915,
        261116, 501515, 501615, 501318, 501317, 501215,
    ),
}
MEDICINE_PREFIX = "51"
MEDICINE_SUBSECTOR = 5
SUBSECTOR_LABELS = {
    1: "Servicios de alquiler, instalacion o mantenimiento/acondicionamiento de infraestructura o equipo",
    2: "Servicios Medicos",
    3: "Servicios de Consultoria y Asesoramiento",
    4: "Otros Servicios Operacionales",
    5: "Medicamentos y compuestos médicos",
    6: "Equipos, instrumentos, utensilios medicos",
    7: "Otros bienes no medicos",
}
PROCEDURE_GROUPS = {
    "Contratación Directa": 1,
    "Concurso Público": 2,
    "Licitación Pública": 2,
    "Adjudicación Simplificada": 3,
    "Adjudicación Simplificada-Homologación": 3,
    "Comparación de Precios": 3,
    "Convenio": 4,
    "Contratación Internacional": 4,
    "Subasta Inversa Electrónica": 4,
}
PROCEDURE_LABELS = {
    1: "Direct deal",
    2: "Licitación Publica",
    3: "Adjudicación Simplificada",
    4: "Subasta Inversa Electronica",
}


def month_index(date: Column) -> Column:
    """Months since January 1960."""
    return ((F.year(date) - 1960) * 12 + F.month(date) - 1).cast("int")


def quarter_index(date: Column) -> Column:
    """Quarters since the first of 1960."""
    return ((F.year(date) - 1960) * 4 + F.quarter(date) - 1).cast("int")


def to_number(text: Column, kind: str = "bigint") -> Column:
    """Text to number value by value; what is not a number is missing."""
    return F.trim(text).try_cast(kind)


def to_text(number: Column) -> Column:
    return number.cast("string")


def product_code(code: Column) -> Column:
    """First eight characters of a catalogue code."""
    return F.substring(code, 1, 8)


def item_code(code: Column) -> Column:
    """The seventeen characters after those, as a number without leading zeros."""
    return to_number(F.regexp_replace(F.substring(code, 9, 17), "^0+", ""))


def class_code(product: Column) -> Column:
    """First six characters of a product code, as a number."""
    return to_number(F.substring(product, 1, 6), "int")


def code_prefix(code: Column, n: int) -> Column:
    """First ``n`` digits of a numeric code, as a number."""
    return to_number(F.substring(to_text(code), 1, n), "int")


def subsector(code: Column, classes: dict[int, tuple[int, ...]] | None = None, medicine_prefix: str = MEDICINE_PREFIX) -> Column:
    """Subsector 1..7 of a class code; of several rules that fit, the highest number wins."""
    classes = classes or SUBSECTOR_CLASSES
    out = F.lit(None).cast("int")
    for number in sorted(classes):
        fits = code.isin(*classes[number])
        if number == MEDICINE_SUBSECTOR:
            fits = fits | to_text(code).startswith(medicine_prefix)
        out = F.when(fits, F.lit(number)).otherwise(out)
    return out


def procedure_group(procedure: Column, groups: dict[str, int] | None = None) -> Column:
    """Group of a selection procedure, missing for one outside the groups."""
    out = F.lit(None).cast("int")
    for name, number in (groups or PROCEDURE_GROUPS).items():
        out = F.when(procedure == name, F.lit(number)).otherwise(out)
    return out


def label_table(spark: SparkSession, labels: dict[int, str], code: str = "code") -> DataFrame:
    """(code, label) rows of a fixed set of labels."""
    return spark.createDataFrame(sorted(labels.items()), f"{code} int, label string")


def year_gap(date: Column, earlier: Column) -> Column:
    """1 where both dates are known and lie at least one calendar year apart."""
    return F.coalesce(F.year(date) - F.year(earlier) >= 1, F.lit(False)).cast("int")
