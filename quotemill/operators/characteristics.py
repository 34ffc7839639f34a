"""Attribute rows of a catalogue -> fields by a dictionary of names -> typed values that agree, or conflicts.

The dictionary is a table: (name, field, prefix). A name stands for each field it is listed under; a name that is not
listed stands for the field of the longest listed prefix that it begins with.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import attributes as a
from quotemill.functions import characteristics as c
from quotemill.functions import text as t

# The names under which sites publish a field.
NAMES = {
    "body": ("Типоразмер корпуса, мм", "Размер резьбы корпуса", "Размер корпуса, ДxШxДл", "Диаметр резьбового корпуса", "Диаметр резьбового корпуса, мм", "Размер корпуса", "Типоразмер", "Корпус", "Тип корпуса", "Размер цилиндрического корпуса, мм", "Резьба корпуса", "Конструкция корпуса", "Обозначение резьбы", "Габаритный размер, мм", "Thread size", "Thread designation", "Housing thread", "Dimensions", "Dimensions [mm]", "Размер резьбы"),
    "length": ("Длина цилиндрического корпуса, мм", "Длина корпуса, мм", "Длина в мм."),
    "diameter": ("Диаметр корпуса, мм", "Диаметр цилиндрического корпуса", "Диаметр гладкого корпуса, мм"),
    "pitch": ("Шаг резьбы, мм", "Шаг резьбы корпуса, мм", "Thread pitch", "Thread pitch [mm]", "Housing thread pitch"),
    "sn": ("Номинальное расстояние переключения, Sn, мм", "Номинальное расстояние срабатывания", "Расстояние срабатывания Sn, мм", "Номинальное расстояние срабатывания [Sn]", "Расстояние срабатывания, мм", "Расстояние срабатывания номинальное (Sn)", "Расстояние переключения, мм", "Расстояние срабатывания", "Sensing distance", "Rated distance [Sn]"),
    "output": ("Схема выхода", "Структура выхода", "Тип контакта / Структура выхода", "Тип выходного сигнала", "Схема подключения", "Тип выхода", "Тип выхода/функция", "Output type", "Выходной сигнал"),
    "function": ("Функция выхода", "Функция переключения", "Тип контакта / Структура выхода", "Тип коммутации", "Тип выхода/функция", "Output function", "Выходной сигнал", "Тип выходного контакта"),
    "mount": ("Способ установки", "Монтаж", "Тип монтажа", "Способ монтажа", "Монтажное исполнение", "Установка", "Installation", "Mounting"),
    "material": ("Материал корпуса датчика", "Материал корпуса", "Housing material", "Обозначение материала корпуса", "Материал корпуса сенсора"),
    "connection": ("Способ подключения", "Соединение", "Электрическое подключение", "Присоединение / Подключение", "Connection type", "Connection", "Вид подключения"),
    "ip": ("Степень защиты IP", "Степень защиты", "Степень защиты корпуса", "Степень защиты по ГОСТ 14254-96", "Степень защиты по ГОСТ 14254-2015", "Степень защиты по IEC 60529", "Degree of protection", "Protection structure"),
    "temperature": ("Рабочая температура окружающей среды, °С", "Диапазон рабочих температур", "Температура эксплуатации, °C", "Температура эксплуатации", "Рабочая температура", "Ambient temperature", "Температура окружающей среды", "Температура окружающей среды, °C"),
    "tmin": ("Температура эксплуатации Min, °C", "Минимальная рабочая температура, °C", "Минимальная рабочая температура, °С"),
    "tmax": ("Температура эксплуатации Max, °C", "Максимальная рабочая температура, °C", "Максимальная рабочая температура, °С"),
    "voltage": ("Диапазон питающих напряжений, В", "Диапазон рабочих напряжений, Uраб.", "Напряжение питания, В", "Диапазон питающего напряжения", "Напряжение питания рабочее", "Рабочее напряжение, В", "Рабочее напряжение, Uраб", "Напряжение питания, Uраб.", "Supply voltage", "Operating voltage"),
    "voltage_type": ("Тип напряжения питания", "Питание"),
    "load": ("Ток нагрузки, мА, не более", "Максимальный рабочий ток, Imax", "Максимальный рабочий ток, мА", "Макс. ток нагрузки, А", "Ток нагрузки максимальный (Ie)", "Коммутируемый ток [DC]", "Максимальный ток коммутационного элемента, мА", "Коммутируемый ток [AC]"),
    "frequency": ("Максимальная частота переключения, Гц", "Частота переключения, Fmax", "Частота переключения, Гц", "Максимальная частота переключения", "Частота переключения максимальная (f)", "Частота переключения max, Гц", "Рабочая частота, Гц", "Switching frequency"),
    "wire_count": ("Количество проводов (pin)", "Кол-во проводов", "Количество проводов"),
    "connector": ("Тип разъёма", "Тип разъема", "Резьба разъема"),
    "pin_count": ("Количество контактов", "Число контактов", "Число контактов, pin", "Количество контактов, pin"),
    "special_pressure": ("Рабочее давление", "Рабочее давление, бар", "Максимальное рабочее давление, бар", "Давление, бар", "Максимальное рабочее давление, МПа", "Рабочее давление, МПа", "Давление max, Бар"),
    "special_immersible": ("Материал погружной части", "Длина погружной части, мм", "Глубина погружения, мм", "Погружное исполнение", "Submersible", "Immersible"),
    "special_analog": ("Аналоговый выход по напряжению, В", "Аналоговый выход по току, мА"),
    "special_speed": ("Диапазон измерения частоты, Гц", "Диапазон частот контроля, Гц"),
    "special_ex": ("Маркировка взрывозащиты", "Взрывозащита"),
}
BEGINNINGS = {"length": "_Длина корпуса", "diameter": "_Диаметр цилиндрического корпуса", "tmin": "_Рабочая температура окружающей среды мин.", "tmax": "_Рабочая температура окружающей среды макс.", "body_type": "_Тип корпуса"}
#: Names of whose value a lone number is the diameter, where it has no thread.
PLAIN_SIZES = ("размер корпуса", "размер цилиндрического корпуса, мм")

NUMBERS = ("length", "diameter", "pitch", "sn", "tmin", "tmax", "vmin", "vmax", "load", "frequency", "wire_count", "pin_count")
TEXTS = ("body_type", "output", "function", "mount", "material", "connection", "ip", "voltage_type", "connector")
FLAGS = ("special_pressure", "special_immersible", "special_analog", "special_speed", "special_ex")
FIELDS = NUMBERS + TEXTS + FLAGS
VALUE = "struct<field:string,number:double,text:string,clash:boolean>"


def dictionary(spark: SparkSession) -> DataFrame:
    """The built-in dictionary: name, field, whether the name is a beginning."""
    rows = [(name, field, False) for field, names in NAMES.items() for name in names] + [(name, field, True) for field, name in BEGINNINGS.items()]
    return spark.createDataFrame(rows, "name string, field string, prefix boolean")


def _resolved(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Different texts (name, ...) with ``key`` and the array ``fields`` of their names."""
    names = names.select(t.attribute_key(F.col("name")).alias("listed"), "field", "prefix").distinct()
    sizes = names.where("prefix").agg(F.coalesce(F.collect_set(F.length("listed")), F.array().cast("array<int>")).alias("sizes"))  # one row, few numbers
    keys = texts.select("name").distinct().withColumn("key", t.attribute_key(F.col("name"))).join(F.broadcast(sizes))
    beginnings = F.transform(F.filter("sizes", lambda n: n <= F.length("key")), lambda n: F.struct(F.left("key", n).alias("listed"), F.lit(True).alias("prefix")))
    tried = keys.select("name", "key", F.explode(F.concat(F.array(F.struct(F.col("key").alias("listed"), F.lit(False).alias("prefix"))), beginnings)).alias("x")).select("name", "key", "x.*")
    found = tried.join(names, ["listed", "prefix"], "left")
    rank = F.when(F.col("prefix"), F.length("listed")).otherwise(2**30)
    best = found.groupBy("name", "key").agg(F.collect_set(F.when(F.col("field").isNotNull(), F.struct(rank.alias("rank"), "field"))).alias("all"))  # fields at most
    best = best.select("name", "key", F.transform(F.filter("all", lambda x: x["rank"] == F.array_max("all")["rank"]), lambda x: x["field"]).alias("fields"))
    return texts.join(best, texts["name"].eqNullSafe(best["name"])).drop(best["name"])


def named_fields(attributes: DataFrame, names: DataFrame) -> DataFrame:
    """attributes(name, ...) with ``key`` and ``field``; a row for each field of its name, null where no name fits.

    names(name, field, prefix). Each different name is looked up once: as it stands, and its beginnings of the lengths
    that are listed, all by equality. A whole name counts before beginnings, of these the longest (with all its fields).
    Null names have no field. Columns ``key`` and ``field`` of the input are replaced.
    """
    known = _resolved(attributes.select("name").distinct(), names)
    x = attributes.drop("key", "field").join(known.withColumnRenamed("name", "known"), F.col("name").eqNullSafe(F.col("known"))).drop("known")
    return x.withColumn("field", F.explode_outer("fields")).drop("fields")


def _value(field: str, number: Column | None = None, text: Column | None = None, clash: Column | None = None) -> Column:
    return F.struct(
        F.lit(field).alias("field"),
        (F.lit(None) if number is None else number).cast("double").alias("number"),
        (F.lit(None) if text is None else text).cast("string").alias("text"),
        (F.lit(False) if clash is None else clash).alias("clash"),
    )


def parsed(field: Column, key: Column, value: Column) -> Column:
    """array of struct(field, number, text, clash): what one attribute says. A size of several threads clashes in pitch."""
    number, ends = a.single_number(value), c.bounds(value)
    said = {
        **{f: [_value(f, number)] for f in ("length", "diameter", "sn", "tmin", "tmax", "wire_count", "pin_count")},
        "pitch": [_value("pitch", c.thread_pitch(number))],
        "output": [_value("output", text=c.output(value))],
        "function": [_value("function", text=c.switching(value))],
        "mount": [_value("mount", text=c.mounting(value))],
        "material": [_value("material", text=c.material(value))],
        "connection": [_value("connection", text=c.connection(value))],
        "ip": [_value("ip", text=c.protection(value))],
        "connector": [_value("connector", text=c.connector(value))],
        "body_type": [_value("body_type", text=c.body_type(value))],
        "voltage_type": [_value("voltage_type", text=c.supply_type(value))],
        "temperature": [_value("tmin", ends["low"]), _value("tmax", ends["high"])],
        "voltage": [_value("vmin", ends["low"]), _value("vmax", ends["high"]), _value("voltage_type", text=c.supply_type(value))],
        "load": [_value("load", c.load_milliamperes(key, value))],
        "frequency": [_value("frequency", c.frequency_hertz(value))],
        **{f: [_value(f, text=F.when(~t.attribute_key(value).isin("нет", "no", "false", "не применяется", "не предусмотрено") & ~(F.coalesce(number, F.lit(1.0)) == 0), "yes"))] for f in FLAGS},
    }
    threads = c.threads(value)
    several = F.size(F.array_distinct(threads)) > 1
    of_threads = F.flatten(F.transform(threads, lambda x: F.array(_value("diameter", x["diameter"]), _value("pitch", x["pitch"]))))
    size = F.when(F.size(threads) > 0, of_threads).when(key.isin(*PLAIN_SIZES), F.array(_value("diameter", number)))
    body = F.concat(F.array(_value("body_type", text=c.body_type(value)), _value("pitch", clash=several)), F.coalesce(size, F.array().cast(f"array<{VALUE}>")))
    out = F.when(field == "body", body)
    for name, values in said.items():
        out = out.when(field == name, F.array(*values))
    return F.filter(out, lambda x: x["number"].isNotNull() | x["text"].isNotNull() | x["clash"])


def typed_fields(attributes: DataFrame, names: DataFrame, by: str) -> DataFrame:
    """attributes(by, name, value) -> by, field, number, text, conflict, said: a row for each field that a product's
    attributes speak of. Values that differ make a conflict, whose number and text are null; ``said`` counts values.

    Placeholders and null values say nothing. Each different pair of name and value is read once and joined back, since a
    catalogue repeats its texts. Values are aggregated as least and greatest, so no group is gathered.
    """
    texts = _resolved(attributes.select("name", "value").distinct().where(~c.is_placeholder(F.col("value"))), names)
    texts = texts.select(F.col("name").alias("known"), F.col("value").alias("written"), "key", F.explode("fields").alias("of"))
    texts = texts.select("known", "written", F.explode(parsed(F.col("of"), F.col("key"), F.col("written"))).alias("x")).select("known", "written", "x.*")
    x = attributes.select(by, "name", "value").join(texts, F.col("name").eqNullSafe(F.col("known")) & (F.col("value") == F.col("written")))
    g = x.groupBy(by, "field").agg(F.min("number").alias("n0"), F.max("number").alias("n1"), F.min("text").alias("t0"), F.max("text").alias("t1"), F.max("clash").alias("clash"), F.count_if(~F.col("clash")).alias("said"))
    conflict = F.col("clash") | F.coalesce(F.col("n0") != F.col("n1"), F.lit(False)) | F.coalesce(F.col("t0") != F.col("t1"), F.lit(False))
    return g.select(by, "field", F.when(~conflict, F.col("n0")).alias("number"), F.when(~conflict, F.col("t0")).alias("text"), conflict.alias("conflict"), "said")


def catalogue(fields: DataFrame, by: str) -> DataFrame:
    """typed_fields() as one row for each product: every field as a column, then its conflicts, sorted, and their number."""
    pick = lambda f, of: F.max(F.when(F.col("field") == f, F.col(of))).alias(f)
    clashes = F.array_sort(F.collect_set(F.when(F.col("conflict"), F.col("field"))))  # fields at most
    return fields.groupBy(by).agg(*[pick(f, "number") for f in NUMBERS], *[pick(f, "text") for f in TEXTS + FLAGS], F.array_join(clashes, ",").alias("conflicts"), F.count_if(F.col("conflict")).alias("n_conflicts"))
