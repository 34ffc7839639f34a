"""Typed characteristics from texts, names by exact key or longest beginning, conflicts, and odd rows."""

import pytest
from pyspark.sql import functions as F

from quotemill.functions import characteristics as c
from quotemill.operators import characteristics as ch
from quotemill.plans import characteristics as plans
from quotemill.session import table

READ = [
    (c.output, {"PNP": "PNP", "pnp/npn": "NPN/PNP", "NAMUR, PNP": "NAMUR/PNP", "2-проводный": "2-wire", "AC 2 пров.": "2-wire", "релейный": "relay", "PNPX": None, "": None, None: None}),
    (c.switching, {"НО": "NO", "размыкающий контакт": "NC", "Замыкающий / размыкающий": "NO/NC", "NO, NC": "NO/NC", "переключающий": "changeover", "NOK": None}),
    (c.mounting, {"Утапливаемый": "flush", "НЕ утапливаемый": "non-flush", "quasi-flush": "quasi-flush", "shielded": "flush", "non-flush": "non-flush", "незаподлицо": "non-flush", "flush or not": None}),
    (c.material, {"Metal": None, "brass, nickel": "brass", "сталь 12Х18Н10Т": "stainless", "нержавеющая сталь": "stainless", "сталь": "steel", "Полиамид PA": "plastic", "Д16Т": "aluminium", "PEEK": "peek", "": None}),
    (c.connection, {"Кабель 2м, разъём M12": "cable+connector", "провод": "cable", "М12": "connector", "клеммы": "terminals", "M120": None}),
    (c.supply_type, {"10-30 В DC": "DC", "AC/DC": "AC/DC", "переменный": "AC", "24 В": None}),
    (c.body_type, {"М18х1": "threaded", "гладкий": "smooth", "кубический": "rectangular", "щелевой": "slot", "4 mm": None}),
    (c.protection, {"IP67, ip 65; IP67": "65/67", "IP69K": "69K", "IP6": None}),
    (c.connector, {"М12": "m12", "M12x1": "m12x1", "": None}),
]


@pytest.mark.parametrize("read,cases", READ, ids=[f.__name__ for f, _ in READ])
def test_texts_are_read(spark, read, cases):
    df = spark.createDataFrame([(k,) for k in cases], "text string")
    assert {r.text: r.got for r in df.select("text", read(F.col("text")).alias("got")).collect()} == cases


def test_threads_bounds_and_units(spark):
    df = spark.createDataFrame([("M18x1",), ("М12 × 1,5 и M8",), ("M30*45",), ("СМ18x1",), ("M0x1",), ("-25 - +70",), ("10–30 В",), ("-40…-5",), ("30..10",), ("7",), (None,)], "t string")
    rows = {r.t: ([tuple(x) for x in r.th or []], r.b and tuple(r.b)) for r in df.select("t", c.threads(F.col("t")).alias("th"), c.bounds(F.col("t")).alias("b")).collect()}
    assert rows["M18x1"][0] == [(18.0, 1.0)] and rows["М12 × 1,5 и M8"][0] == [(12.0, 1.5), (8.0, None)]
    assert rows["M30*45"][0] == [(30.0, None)] and rows["СМ18x1"][0] == [] and rows["M0x1"][0] == []
    assert rows["-25 - +70"][1] == (-25.0, 70.0) and rows["10–30 В"][1] == (10.0, 30.0) and rows["-40…-5"][1] == (-40.0, -5.0)
    assert rows["30..10"][1] is None and rows["7"][1] is None and rows[None] == ([], None)
    units = spark.createDataFrame([("макс. ток, а", "0,2"), ("ток", "5...200 мА"), ("ток", "2 А"), ("ток", "-5…3"), ("ток", "1 2 3")], "k string, t string")
    assert [r[0] for r in units.select(c.load_milliamperes(F.col("k"), F.col("t"))).collect()] == [200.0, 200.0, 2000.0, None, None]


def test_denied_immersion_is_no_execution(spark):
    df = spark.createDataFrame([("не погружной",), ("погружной, Exia",), ("not immersible; submersible",), (None,)], "t string")
    assert [r[0] for r in df.select(c.special_executions(F.col("t"))).collect()] == [[], ["ex", "immersible"], ["immersible"], []]


def test_names_by_key_then_by_longest_beginning(spark):
    names = spark.createDataFrame([("Size:", "size", False), ("Size:", "kind", False), ("_Len", "short", True), ("_Length of", "long", True), ("Size: x", "never", False)], "name string, field string, prefix boolean")
    rows = spark.createDataFrame([(1, " SIZE "), (2, "_length of body"), (3, "_len."), (4, "other"), (5, None), (6, "")], "id int, name string").withColumn("field", F.lit("clash"))
    got = sorted((r.id, r.field) for r in ch.named_fields(rows, names).collect())
    assert sorted(got, key=str) == sorted([(1, "kind"), (1, "size"), (2, "long"), (3, "short"), (4, None), (5, None), (6, None)], key=str)
    none = names.where("prefix and not prefix")
    assert {r.field for r in ch.named_fields(rows, none).collect()} == {None}


def test_conflicts_placeholders_and_several_threads(spark):
    rows = [
        (1, "Типоразмер", "M12x1 / M18x1"), (1, "Монтаж", "заподлицо"), (1, "Installation", "flush"), (1, "Степень защиты", "н/д"),
        (2, "Монтаж", "заподлицо"), (2, "Монтаж", "non-flush"), (2, "Рабочая температура", "-25…+70"), (2, "Температура эксплуатации Min, °C", "-25"),
        (3, None, "x"), (3, "Монтаж", None), (4, "Тип контакта / Структура выхода", "PNP NO"), (4, "Тип контакта / Структура выхода", "PNP NO"),
        (5, "Взрывозащита", "нет"), (6, "Взрывозащита", "Ex"), (7, "Размер корпуса", "18 мм"), (8, "Типоразмер", "18 мм"),
    ]
    typed = ch.typed_fields(spark.createDataFrame(rows, "id int, name string, value string"), ch.dictionary(spark), "id")
    got = {(r.id, r.field): (r.number, r.text, r.conflict, r.said) for r in typed.collect()}
    assert got == {
        (1, "body_type"): (None, "threaded", False, 1), (1, "diameter"): (None, None, True, 2), (1, "pitch"): (None, None, True, 2), (1, "mount"): (None, "flush", False, 2),
        (2, "mount"): (None, None, True, 2), (2, "tmin"): (-25.0, None, False, 2), (2, "tmax"): (70.0, None, False, 1),
        (4, "output"): (None, "PNP", False, 2), (4, "function"): (None, "NO", False, 2), (6, "special_ex"): (None, "yes", False, 1), (7, "diameter"): (18.0, None, False, 1),
    }
    wide = {r.id: r for r in ch.catalogue(typed, "id").collect()}
    assert wide[1].conflicts == "diameter,pitch" and wide[2].n_conflicts == 1 and wide[4].output == "PNP" and set(wide) == {1, 2, 4, 6, 7}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "id int, name string, value string")
    assert ch.typed_fields(empty, ch.dictionary(spark), "id").count() == 0


def test_attributes_of_one_split_are_written_by_many_tasks(spark):
    d = "/root/testdata/sf0.01"
    parts, written = table(spark, d, "part"), plans._written(spark, d)
    assert parts.rdd.getNumPartitions() == 1
    own = written.where(F.col("name") == "Вес, г").groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in own) == parts.count() and len(own) == 4 and max(r["count"] for r in own) < parts.count() / 2


def test_each_name_meets_the_dictionary_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ch, "named_fields", lambda rows, names, of=ch.named_fields: seen.append(rows) or of(rows, names))
    d = "/root/testdata/sf0.001"
    got = plans.jo22_field_names(spark, d)
    assert seen[0].count() == plans._written(spark, d).select("name").distinct().count()
    assert got.where("key = 'вес, г'").first()["n"] == table(spark, d, "part").count()
