"""Queries over written-out sensor attributes: names to fields, typed values and conflicts, threads, executions, coverage.

The given tables hold no such attributes, so ``PARTS`` and ``LINES`` write them from their columns as sites would: Russian
and English names, units, ranges, threads, placeholders. The queries read only the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.functions import characteristics as c
from quotemill.operators import characteristics as ch
from quotemill.operators import designations as de
from quotemill.session import dealt, table

#: (name, value) of each product as expressions over ``part`` that both engines take.
PARTS = (
    ("case p_partkey % 5 when 0 then 'Типоразмер' when 1 then ' Thread  size:' when 2 then 'Размер корпуса' when 3 then 'КОРПУС' else 'Тип корпуса' end", "case p_partkey % 5 when 0 then concat('M', p_size, 'x1') when 1 then concat('М', p_size, '×1,5 (резьба)') when 2 then concat(p_size, ' мм') when 3 then concat('M12x1 / M', p_size, 'x1') else concat('прямоугольный ', p_size, 'x40x12') end"),
    ("case p_size % 3 when 0 then 'Схема выхода' when 1 then 'Output type' else 'Тип выхода/функция' end", "case p_partkey % 7 when 0 then 'PNP NO' when 1 then 'NPN, НЗ' when 2 then 'PNP/NPN NO+NC' when 3 then 'NAMUR' when 4 then '2-х проводный AC' when 5 then 'реле, переключающий' else 'без выхода' end"),
    ("case p_size % 2 when 0 then 'Функция выхода' else 'Тип коммутации' end", "case when p_name like '%widget%' then 'размыкающий' when p_name like '%gadget%' then 'замыкающий' when p_name like '%gear%' then 'нормально замкнутый' else 'NO / NC' end"),
    ("case p_size % 2 when 0 then 'Монтаж' else 'Installation' end", "case p_partkey % 6 when 0 then 'Заподлицо' when 1 then 'не заподлицо' when 2 then 'flush' when 3 then 'unshielded' when 4 then 'квазиутапливаемый' else 'не встраиваемый' end"),
    ("case p_size % 2 when 0 then 'Материал корпуса' else 'Housing material' end", "case when p_type = 'ECONOMY' then 'латунь никелированная' when p_type = 'STANDARD' then 'Сталь AISI 304' when p_type = 'PROMO' then 'металл' when p_type = 'SMALL' then 'PBT' else p_type end"),
    ("'Способ подключения'", "case p_partkey % 4 when 0 then 'кабель 2 м' when 1 then 'разъём' when 2 then 'Кабель с разъёмом M8' else 'клеммник' end"),
    ("'Степень защиты'", "case p_size % 4 when 0 then 'IP67, IP 65; ip67' when 1 then 'IP69K' when 2 then 'Нет данных' else 'высокая' end"),
    ("'Рабочая температура'", "concat('-', 25 + p_size % 3 * 10, '...+', 60 + p_size % 2 * 10, ' °C')"),
    ("'_Рабочая температура окружающей среды мин. (паспорт)'", "concat('-', 25 + p_partkey % 3 * 10)"),
    ("case p_size % 2 when 0 then 'Напряжение питания, В' else 'Supply voltage' end", "case p_size % 3 when 0 then concat(10, ' - ', 20 + p_size, ' В DC') when 1 then concat(p_size * 10, ' В AC') else concat(20, '…', 200 + p_size, ' AC/DC') end"),
    ("'Питание'", "case p_partkey % 3 when 0 then 'постоянное' when 1 then 'переменное' else '-' end"),
    ("case p_partkey % 3 when 0 then 'Максимальный рабочий ток, мА' when 1 then 'Макс. ток нагрузки, А' else 'Максимальный рабочий ток, Imax' end", "case p_partkey % 3 when 0 then concat('5...', 100 + p_size) when 1 then concat('0,', 10 + p_size) else concat(p_size, ' A') end"),
    ("'Частота переключения, Гц'", "case p_size % 2 when 0 then concat(p_size, ',5 кГц') else concat(p_size * 10, ' Hz') end"),
    ("case p_size % 2 when 0 then 'Тип разъёма' else 'Тип разъема' end", "case p_partkey % 3 when 0 then 'М12 x 1' when 1 then 'm12 x 1' else 'DEUTSCH DT04' end"),
    ("'Кол-во проводов'", "concat(p_size % 3 + 2, '')"),
    ("'Число контактов'", "concat(p_size % 3 + 3, case when p_partkey % 8 = 0 then ' из 5' else '' end)"),
    ("case when p_partkey % 9 = 0 then '_Длина корпуса (без разъёма)' else 'Длина корпуса, мм' end", "concat(p_size + 20, ' мм')"),
    ("'Маркировка взрывозащиты'", "case p_partkey % 4 when 0 then 'нет' when 1 then '—' when 2 then '0' else '1Ex ia IIC' end"),
    ("'Вес, г'", "concat(p_size, '')"),
)
#: The same of each price line: what a second site says of the product, which may disagree.
LINES = (("'Номинальное расстояние срабатывания'", "concat(case when l_linenumber = 7 then l_suppkey % 50 else l_partkey % 50 end, ' мм')"),)
#: Maker and designation of each product; the parts need not fit together.
CODES = (
    "case p_partkey % 3 when 0 then 'sis' when 1 then 'PR' else 'pr' end",
    "case when p_partkey % 3 = 0 then concat('SIS-', case p_size % 3 when 0 then 12 when 1 then 18 else 30 end, case when p_type = 'PROMO' then 'V' else 'N' end, '55-', case p_size % 4 when 0 then 'NO' when 1 then 'NC' when 2 then 'NONC' else 'X' end, '-', case p_size % 5 when 0 then 'PNP' when 1 then 'NPN' when 2 then 'AC' else 'DC' end, '-', p_size, case when p_size % 2 = 0 then ',5' else '' end, '-', case when p_partkey % 2 = 0 then 'ST' else 'tf' end) else concat('PR', case p_size % 3 when 0 then 'CM' when 1 then ' W' else '' end, case p_partkey % 4 when 0 then '08' when 1 then '12' when 2 then '18' else '30' end, '–', case p_size % 8 when 0 then '1.5' when 1 then '2' when 2 then '4' when 3 then '5' when 4 then '8' when 5 then '10' when 6 then '15' else '3' end, 'd', case p_partkey % 5 when 0 then 'n2' when 1 then 'P2' when 2 then 'N' else 'P' end) end",
)
#: A purpose text of each product.
PURPOSE = "case p_partkey % 8 when 0 then 'Датчик контроля минимальной скорости' when 1 then 'не является погружным' when 2 then 'Погружной, для высокого давления' when 3 then 'Взрывозащищённый NAMUR' when 4 then 'щелевой, аналоговый выход' when 5 then 'non-submersible; Ex ia' when 6 then 'fully submersible' else p_name end"


def _written(spark: SparkSession, d: str) -> DataFrame:
    def pairs(rows: DataFrame, key: str, exprs):
        held = F.array(*[F.struct(F.expr(n).alias("name"), F.expr(v).alias("value")) for n, v in exprs])
        return rows.select(F.col(key).alias("rule_id"), F.explode(held).alias("x")).select("rule_id", "x.*")

    return pairs(_parts(spark, d), "p_partkey", PARTS).unionAll(pairs(table(spark, d, "lineitem"), "l_partkey", LINES))


def _parts(spark: SparkSession, d: str) -> DataFrame:
    """Products dealt over tasks before their attributes are written: the file may be one split, and each row becomes many."""
    return dealt(table(spark, d, "part"), "p_partkey")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return ch.typed_fields(_written(spark, d), ch.dictionary(spark), "rule_id")


def jo22_field_names(spark: SparkSession, d: str) -> DataFrame:
    """Attribute names by the fields they stand for, exactly or by their beginning; null: no field."""
    names = _written(spark, d).groupBy("name").agg(F.count("*").alias("rows"))
    return ch.named_fields(names, ch.dictionary(spark)).groupBy("key", "field").agg(F.sum("rows").alias("n"))


def fn21_typed_values(spark: SparkSession, d: str) -> DataFrame:
    """How often products agree on each typed value, by field."""
    return _typed(spark, d).where("not conflict").groupBy("field", "number", "text").agg(F.count("*").alias("products"), F.sum("said").alias("said"))


def fn16_threads(spark: SparkSession, d: str) -> DataFrame:
    """The metric threads of size texts; a second number that is too long for a pitch gives none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.expr(PARTS[0][1]).alias("value"))
    return p.select("rule_id", F.posexplode(c.threads(F.col("value"))).alias("place", "x")).select("rule_id", "place", "x.diameter", "x.pitch")


def fn22_special(spark: SparkSession, d: str) -> DataFrame:
    """Special executions that purpose texts name; a denied immersion is none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.expr(PURPOSE).alias("text"))
    return p.select("rule_id", F.array_join(c.special_executions(F.col("text")), ",").alias("special"))


def co6_catalogue(spark: SparkSession, d: str) -> DataFrame:
    """Each product with its typed fields as columns and the names of those that conflict."""
    return ch.catalogue(_typed(spark, d), "rule_id")


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    codes = _parts(spark, d).select(F.col("p_partkey").alias("rule_id"), F.expr(CODES[0]).alias("maker"), F.expr(CODES[1]).alias("code"))
    return de.decoded(codes, "rule_id", de.built_in(spark))


def fn28_decoded_fields(spark: SparkSession, d: str) -> DataFrame:
    """What designations say, by the tables of their makers' rules; codes whose parts do not fit say nothing."""
    return _decoded(spark, d)


def fn29_enriched_fields(spark: SparkSession, d: str) -> DataFrame:
    """Each product's fields from its card's attributes and its designation, and how the two agree."""
    return de.enriched(_typed(spark, d), _decoded(spark, d), "rule_id")


def co7_field_audit(spark: SparkSession, d: str) -> DataFrame:
    """By brand and field: products of the brand, those whose attributes speak of it, known values and conflicts."""
    part = table(spark, d, "part").select(F.col("p_partkey").alias("rule_id"), F.col("p_brand").alias("manufacturer"))
    brands = part.groupBy("manufacturer").agg(F.count("*").alias("products"))
    by = _typed(spark, d).join(part, "rule_id").groupBy("manufacturer", "field").agg(F.count("*").alias("spoken"), F.count_if(~F.col("conflict")).alias("known"), F.count_if("conflict").alias("conflicts"))
    return by.join(brands, "manufacturer").withColumn("known_percent", F.round(F.col("known") * 100 / F.col("products"), 4))


QUERIES = {q.__name__: q for q in (jo22_field_names, fn21_typed_values, fn16_threads, fn22_special, co6_catalogue, co7_field_audit, fn28_decoded_fields, fn29_enriched_fields)}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _key(x: str) -> str:
    return rf"rtrim(lower(replace(replace(trim(regexp_replace({x}, '\s+', ' ', 'g')), 'Ё', 'Е'), 'ё', 'е')), ': ')"


_NAMES = ", ".join(f"({_text(name)}, '{field}', {prefix})" for field, name, prefix in [(f, n, "false") for f, ns in ch.NAMES.items() for n in ns] + [(f, n, "true") for f, n in ch.BEGINNINGS.items()])
_WRITTEN = f"""written as (select p_partkey rule_id, name, value from part, lateral (values {", ".join(f"({n}, {v})" for n, v in PARTS)}) s(name, value)
  union all select l_partkey, {LINES[0][0]}, {LINES[0][1]} from lineitem),
names as (select distinct {_key("name")} listed, field, prefix from (values {_NAMES}) n(name, field, prefix)),
keyed as (select rule_id, {_key("name")} k, value from written),
fielded as (select rule_id, k, value, field, row_number() over () id from keyed left join names on k = listed and not prefix),
named as (select rule_id, k, value, coalesce(f.field, p.field) field from fielded f left join names p on f.field is null and prefix and starts_with(k, listed)
  qualify rank() over (partition by id order by length(listed) desc) = 1)"""
_NUMBERS = r"list_transform(regexp_extract_all({}, '[-+]?\d+(?:[.,]\d+)?'), lambda v: cast(replace(v, ',', '.') as double))"
_TYPED = rf"""{_WRITTEN},
x as (select rule_id, k, field, value, {_key("value")} v, {_NUMBERS.format("value")} nums, {_NUMBERS.format(r"regexp_replace(value, '(\d) *(-|…|\.\.\.) *', '\1 _ ', 'g')")} ends
  from named where field is not null and {_key("value")} not in ('', '-', '—', 'не указано', 'нет данных', 'н/д', 'n/a')),
y as (select *, case when len(nums) = 1 then nums[1] end num, case when len(ends) = 2 and ends[1] <= ends[2] then ends end b,
  list_transform(regexp_extract_all(value, '[MМ] *\d+(?:[x×]\d+(?:,\d+)?)?'), lambda m: [cast(regexp_extract(m, '\d+') as double), try_cast(replace(regexp_extract(m, '[x×](.*)', 1), ',', '.') as double)]) th from x),
said as (
  select rule_id, field, num number, null text, false clash from y where field in ('length', 'diameter', 'sn', 'tmin', 'tmax', 'wire_count', 'pin_count')
  union all select rule_id, field, case when num > 0 and num <= 6 then num end, null, false from y where field = 'pitch'
  union all select rule_id, field, null, case when v like '%pnp%' and v like '%npn%' then 'NPN/PNP' when v like '%pnp%' then 'PNP' when v like '%npn%' then 'NPN' when v like '%namur%' then 'NAMUR' when v like '2-х провод%' then '2-wire' when v like '%реле%' then 'relay' end, false from y where field = 'output'
  union all select rule_id, field, null, case when regexp_matches(v, '(^|[^a-z])no([^a-z]|$)') and regexp_matches(v, '(^|[^a-z])nc([^a-z]|$)') then 'NO/NC' when regexp_matches(v, '(^|[^a-z])no([^a-z]|$)') or v like 'замыкающ%' then 'NO'
    when regexp_matches(v, '(^|[^a-z])nc([^a-z]|$)|нормально замкнут|размыкающ|нз$') then 'NC' when v like '%переключающ%' then 'changeover' end, false from y where field = 'function'
  union all select rule_id, field, null, case when v like 'квази%' then 'quasi-flush' when regexp_matches(v, '^(unshielded|не заподлицо|не встраиваемый)$') then 'non-flush' when v in ('flush', 'заподлицо') then 'flush' end, false from y where field = 'mount'
  union all select rule_id, field, null, case when v = 'металл' then null when v like '%латун%' then 'brass' when v like '%aisi 304%' then 'stainless' when v = 'pbt' then 'plastic' else v end, false from y where field = 'material'
  union all select rule_id, field, null, case when v like '%кабел%' and v like '%разъем%' then 'cable+connector' when v like '%кабел%' then 'cable' when v like '%разъем%' then 'connector' when v like '%клем%' then 'terminals' end, false from y where field = 'connection'
  union all select rule_id, field, null, nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(upper(value), 'IP ?(\d\dK?)', 1))), '/'), ''), false from y where field = 'ip'
  union all select rule_id, field, null, replace(v, 'м12', 'm12'), false from y where field = 'connector'
  union all select rule_id, 'voltage_type', null, case when v like '%ac/dc%' then 'AC/DC' when regexp_matches(v, 'ac|переменн') then 'AC' when regexp_matches(v, 'dc|постоянн') then 'DC' end, false from y where field in ('voltage_type', 'voltage')
  union all select rule_id, 'tmin', b[1], null, false from y where field = 'temperature' union all select rule_id, 'tmax', b[2], null, false from y where field = 'temperature'
  union all select rule_id, 'vmin', b[1], null, false from y where field = 'voltage' union all select rule_id, 'vmax', b[2], null, false from y where field = 'voltage'
  union all select rule_id, field, coalesce(num, b[2]) * case when k like '%, а' or value like '% A' then 1000 else 1 end, null, false from y where field = 'load'
  union all select rule_id, field, num * case when v like '%кгц' then 1000 else 1 end, null, false from y where field = 'frequency'
  union all select rule_id, field, null, case when v not in ('нет', '0') then 'yes' end, false from y where field like 'special%'
  union all select rule_id, 'body_type', null, case when regexp_matches(v, 'резьб|(^| )[mм] *\d') then 'threaded' when v like '%прямоугол%' then 'rectangular' end, false from y where field in ('body', 'body_type')
  union all select rule_id, 'pitch', null, null, true from y where field = 'body' and len(list_distinct(th)) > 1
  union all select rule_id, 'diameter', t[1], null, false from (select rule_id, unnest(th) t from y where field = 'body')
  union all select rule_id, 'pitch', t[2], null, false from (select rule_id, unnest(th) t from y where field = 'body') where t[2] <= 6
  union all select rule_id, 'diameter', num, null, false from y where field = 'body' and len(th) = 0 and k = 'размер корпуса'),
grouped as (select rule_id, field, min(number) n0, min(text) t0, bool_or(clash) or count(distinct number) > 1 or count(distinct text) > 1 conflict, count(*) filter (where not clash) said
  from said where number is not null or text is not null or clash group by all),
typed as (select rule_id, field, case when not conflict then n0 end number, case when not conflict then t0 end text, conflict, said from grouped)"""
_DECODED = rf"""codes as (select p_partkey rule_id, lower({CODES[0]}) maker, upper(replace(replace({CODES[1]}, ' ', ''), '–', '-')) code from part),
pr as (select rule_id, regexp_extract(code, '^PR(CM|W)?', 1) conn, regexp_extract(code, '^PR(?:CM|W)?(\d\d)', 1) size, regexp_extract(code, '-([\d.]+)D', 1) sn, regexp_extract(code, 'D([NP]2?)$', 1) o from codes where maker = 'pr'),
pm as (select *, case when (size, sn) in (('08', '1.5'), ('12', '2'), ('18', '5'), ('30', '10')) then 'flush' when (size, sn) in (('08', '2'), ('12', '4'), ('18', '8'), ('30', '15')) then 'non-flush' end mount from pr),
sis as (select rule_id, string_split(code, '-') c from codes where maker = 'sis' and not contains(code, '-X-')),
sg as (select rule_id, left(c[2], 2) size, substr(c[2], 3, 1) mount, c[3] fun, c[4] o, c[5] sn, c[6] mat from sis),
dec as (
  select rule_id, 'pr' rule, f.field, f.number, f.txt, f.standard, false review from pm, lateral (values
    ('connection', null::double, case conn when 'CM' then 'connector' when 'W' then 'cable+connector' else 'cable' end, false), ('diameter', size::double, null, false), ('pitch', case when size = '30' then 1.5 else 1.0 end, null, false),
    ('sn', sn::double, null, false), ('output', null, case when left(o, 1) = 'N' then 'NPN' else 'PNP' end, false), ('function', null, case when o like '%2' then 'NC' else 'NO' end, false), ('mount', null, mount, false),
    ('body_type', null, 'threaded', true), ('voltage_type', null, 'DC', true), ('load', 200, null, true), ('ip', null, '67', true)) f(field, number, txt, standard) where mount is not null
  union all select rule_id, 'sis', f.field, f.number, f.txt, f.standard, size = '30' from sg, lateral (values
    ('diameter', size::double, null::varchar, false), ('pitch', case when size <> '30' then 1.0 end, null, false), ('mount', null, case mount when 'V' then 'flush' else 'non-flush' end, false), ('function', null, case fun when 'NONC' then 'NO/NC' else fun end, false),
    ('output', null, case when o in ('AC', 'DC') then '2-wire' else o end, false), ('voltage_type', null, case when o = 'AC' then 'AC' else 'DC' end, false), ('sn', replace(sn, ',', '.')::double, null, false), ('material', null, case mat when 'ST' then 'stainless' else 'plastic' end, false), ('body_type', null, 'threaded', true)) f(field, number, txt, standard)
    where f.field <> 'pitch' or size <> '30')"""
_WIDE = ", ".join([f"max(number) filter (where field = '{f}') {f}" for f in ch.NUMBERS] + [f"max(text) filter (where field = '{f}') \"{f}\"" for f in ch.TEXTS + ch.FLAGS])

SQL = {
    "jo22_field_names": f"with {_WRITTEN} select k \"key\", field, count(*) n from named group by all",
    "fn21_typed_values": f"with {_TYPED} select field, number, text, count(*) products, cast(sum(said) as bigint) said from typed where not conflict group by all",
    "fn16_threads": rf"""with v as (select p_partkey rule_id, {PARTS[0][1]} value from part),
m as (select rule_id, unnest(list_transform(range(len(all_m)), lambda i: {{'place': i, 'm': all_m[i + 1]}})) s from (select rule_id, regexp_extract_all(value, '[MМ]\d+[x×][\d,]+') all_m from v))
select rule_id, cast(s.place as int) place, cast(regexp_extract(s.m, '\d+') as double) diameter, cast(replace(regexp_extract(s.m, '[x×](.*)$', 1), ',', '.') as double) pitch from m""",
    "fn22_special": rf"""with v as (select p_partkey rule_id, lower({PURPOSE}) t from part),
w as (select rule_id, replace(t, 'ё', 'е') t from v)
select rule_id, concat_ws(',', case when t like '%аналогов%' then 'analog' end, case when t like '%взрывозащи%' or regexp_matches(t, '(^|[^a-z])ex ?[miad]') then 'ex' end,
  case when regexp_matches(t, 'погружн|submersible') and not regexp_matches(t, 'не является погружн|non-submersible') then 'immersible' end, case when t like '%namur%' then 'namur' end,
  case when t like '%высокого давления%' then 'pressure' end, case when t like '%щелев%' then 'slot' end, case when t like '%минимальной скорости%' then 'speed' end) special from w""",
    "co6_catalogue": f"with {_TYPED} select rule_id, {_WIDE}, coalesce(string_agg(field, ',' order by field) filter (where conflict), '') conflicts, count(*) filter (where conflict) n_conflicts from typed group by all",
    "fn28_decoded_fields": f"with {_DECODED} select rule_id, rule, field, number, txt text, standard, review from dec",
    "fn29_enriched_fields": f"""with {_TYPED}, {_DECODED},
j as (select rule_id, field, t.number tn, t.text tt, t.conflict, d.number dn, d.txt dt, d.standard, d.review, t.number is not distinct from d.number and t.text is not distinct from d.txt agrees from typed t full join dec d using (rule_id, field)),
o as (select *, case when conflict then 'conflict' when standard is null then 'card' when conflict is null then case when review then 'review' else 'filled' end when agrees then 'confirmed' when standard then 'card' else 'conflict' end outcome from j)
select rule_id, field, case when outcome not in ('conflict', 'review') then coalesce(tn, dn) end number, case when outcome not in ('conflict', 'review') then coalesce(tt, dt) end text, outcome from o""",
    "co7_field_audit": f"""with {_TYPED}, b as (select p_brand manufacturer, count(*) products from part group by all)
select manufacturer, field, spoken, known, conflicts, products, round(known * 100 / products, 4) known_percent
from (select p_brand manufacturer, field, count(*) spoken, count(*) filter (where not conflict) known, count(*) filter (where conflict) conflicts from typed join part on p_partkey = rule_id group by all) join b using (manufacturer)""",
}
