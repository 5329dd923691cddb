"""Units, packs, scope and specifications of lines. The oracles state each rule again in SQL, from the same fixed patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import units as U
from tallywright.plans.base import Registry
from tallywright.plans.retrieval import q4, s4

R = Registry()

#: Lines with units and texts that match, miss and go out of range; valid in both dialects.
TEXTS = (
    "BOX/@", "case/@00000", "@/BX", "0/cs then @ pcs", "@ PC SET", "9@9 piece kit", "Box of @", "pack: @", "pair of @", "bundle of 9@9", "@ per box", "@ dozen eggs", "@ ct", "@0000 each and more",
    "no number here", "Case 580 loader", "a gross of pens", "per @", "@-pack", "labor at hourly rate", "furnish and install pump with valve, hose and pipe", "annual support, @ seats", "spare filter", "hot mix @ ton",
    "24 port switch PoE 10 gbps", "16GB RAM 2TB SSD", "512 MB memory, hard drive", "230/400 V motor 1.5 kW three phase 2 hp", "1-1/2 inch brass valve 150 PSI", "5/16 in SS bolt class 300", "SCH 40 pvc pipe 12 gpm", "800 lumens 60W lamp",
    "100 mbps 7 port hub", "9 volt cell with cable, clip, box", "2 year warranty rack mounted unit", "3 phase 480V 75 kva", "1/4 HP pump", "ductile iron 4-1/2 in", "0 GB drive", "gravel and sand",
)
_CASE = " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(TEXTS))
DESCRIBED = f"""SELECT p_partkey, p_size, p_retailprice AS price, CASE p_partkey % 9 WHEN 0 THEN 'EA' WHEN 1 THEN ' bx' WHEN 2 THEN 'Dz' WHEN 3 THEN '??' WHEN 4 THEN NULL WHEN 5 THEN 'MFT' WHEN 6 THEN 'PR' WHEN 7 THEN 'TON' ELSE '' END AS unit,
 CASE p_partkey % 5 WHEN 0 THEN 'each' WHEN 1 THEN 'large carton' WHEN 2 THEN NULL WHEN 3 THEN 'one gallon drum' ELSE 'odd' END AS unit_text,
 CASE WHEN p_partkey % 101 = 0 THEN NULL ELSE replace(CASE p_partkey % {len(TEXTS)} {_CASE} END, '@', CAST(p_size AS VARCHAR(9))) END AS text FROM part"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with units and texts."""
    return spark.sql(DESCRIBED.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def _q(text: str) -> str:
    return text.replace("'", "''")


_UNIT_ROWS = ", ".join(
    f"({n}, '{code}', '{kind}', {pack}.0::DOUBLE, '{base}', {int(packaged)}, {int(bulk)}, {int(single)})" for n, (code, kind, pack, base, packaged, bulk, single) in enumerate(U.UNITS)
)
UNIT_CTE = f"""line AS ({DESCRIBED}), known(place, code, kind, pack, base, packaged, bulk, single) AS (VALUES {_UNIT_ROWS}),
clean AS (SELECT *, upper(trim(coalesce(unit, ''))) AS u, upper(trim(coalesce(unit_text, ''))) AS t FROM line),
part_hit AS (SELECT p_partkey, arg_min(code, place) AS code FROM clean JOIN known ON length(code) > 2 AND contains(t, code) GROUP BY 1),
chosen AS (SELECT c.*, CASE WHEN a.code IS NOT NULL THEN a.code WHEN b.code IS NOT NULL THEN b.code ELSE h.code END AS code, CASE WHEN a.code IS NOT NULL OR b.code IS NOT NULL THEN 'HIGH' WHEN h.code IS NOT NULL THEN 'MEDIUM' WHEN u <> '' THEN 'LOW' ELSE 'NONE' END AS sure
 FROM clean c LEFT JOIN known a ON a.code = c.u LEFT JOIN known b ON b.code = c.t LEFT JOIN part_hit h ON h.p_partkey = c.p_partkey),
unit_of AS (SELECT p_partkey, text, price, coalesce(k.code, CASE WHEN u = '' THEN 'UNKNOWN' ELSE u END) AS unit, coalesce(k.kind, 'OTHER') AS kind, coalesce(k.pack, 1.0) AS pack, coalesce(k.base, 'OTHER') AS base,
 coalesce(k.packaged, 0) AS packaged, coalesce(k.bulk, 0) AS bulk, coalesce(k.single, CASE WHEN u = '' THEN 1 ELSE 0 END) AS single, sure AS confidence FROM chosen c LEFT JOIN known k ON k.code = c.code)"""
_NUMBERS = ", ".join(f"TRY_CAST(nullif(regexp_extract(text, '(?i){_q(p)}', 1), '') AS DOUBLE) AS n{i}, upper(regexp_extract(text, '(?i){_q(p)}', 0)) AS r{i}" for i, (_, p, *_rest) in enumerate(U.PACKS))
_WHICH = " ".join(f"WHEN n{i} BETWEEN 1 AND {high} THEN {i}" for i, (_, _, high, *_rest) in enumerate(U.PACKS))
_PICK = lambda make: "CASE w " + " ".join(f"WHEN {i} THEN {make(i, rule)}" for i, rule in enumerate(U.PACKS)) + " END"
_KIND = _PICK(lambda i, rule: f"'{rule[3]}'" if rule[3] else f"CASE WHEN contains(r{i}, 'BX') OR contains(r{i}, 'BOX') THEN 'BOX' WHEN contains(r{i}, 'CS') OR contains(r{i}, 'CASE') THEN 'CASE' ELSE 'PACK' END")
PACK_CTE = f"""pack_of AS (SELECT p_partkey, {_PICK(lambda i, r: f'n{i}')} AS size, {_KIND} AS kind, {_PICK(lambda i, r: f"'{r[4]}'")} AS confidence, {_PICK(lambda i, r: f"'{r[0]}'")} AS pattern
 FROM (SELECT *, CASE {_WHICH} END AS w FROM (SELECT p_partkey, {_NUMBERS} FROM line)))"""
RECORD_CTE = """record AS (SELECT u.p_partkey, u.price, coalesce(p.kind, u.kind) AS kind, coalesce(p.size, u.pack) AS pack, unit, base, CASE WHEN p.size > 1 THEN 1 ELSE packaged END AS packaged, bulk,
 CASE WHEN p.size IS NULL THEN single WHEN p.size = 1 THEN 1 ELSE 0 END AS single, coalesce(p.confidence, u.confidence) AS confidence FROM unit_of u JOIN pack_of p USING (p_partkey))"""


@R.query("str14_uom_canonical", f"WITH {UNIT_CTE} SELECT p_partkey, unit, kind, pack, base, packaged, bulk, single, confidence FROM unit_of")
def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical units of all lines: by code, by description, by a code within the description, or unknown."""
    return described(spark, sf_dir).select("p_partkey", U.canonical_unit(F.col("unit"), F.col("unit_text")).alias("u")).select("p_partkey", "u.*")


@R.query("str15_pack_size", f"WITH line AS ({DESCRIBED}), {PACK_CTE} SELECT * FROM pack_of")
def str15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack sizes of all texts by seven ordered patterns."""
    return described(spark, sf_dir).select("p_partkey", U.pack_of(F.col("text")).alias("k")).select("p_partkey", "k.size", "k.kind", "k.confidence", "k.pattern")


@R.query("str16_commercial_record", f"WITH {UNIT_CTE}, {PACK_CTE}, {RECORD_CTE} SELECT * EXCLUDE (price) FROM record")
def str16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commercial records: the text's pack overrides the unit's."""
    line = U.commercial_record(F.col("unit"), F.col("unit_text"), F.col("text")).alias("r")
    return described(spark, sf_dir).select("p_partkey", line).select("p_partkey", "r.*")


_COUNTS = ", ".join(f"TRY_CAST(nullif(regexp_extract(t, '{_q(p)}', 1), '') AS DOUBLE) AS c{i}" for i, p in enumerate(U.COUNTS))


@R.query(
    "str17_pack_count",
    rf"""WITH line AS ({DESCRIBED}) SELECT p_partkey, CASE WHEN regexp_matches(t, '\bdozen\b') THEN 12.0 WHEN regexp_matches(t, '\bgross\b') THEN 144.0 WHEN c0 BETWEEN 1 AND 100000 THEN c0 WHEN c1 BETWEEN 1 AND 100000 THEN c1 WHEN c2 BETWEEN 1 AND 100000 THEN c2
 WHEN c3 BETWEEN 1 AND 100000 THEN c3 END::DOUBLE AS n FROM (SELECT p_partkey, t, {_COUNTS} FROM (SELECT p_partkey, lower(text) AS t FROM line))""",
)
def str17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second pack parser over all texts."""
    return described(spark, sf_dir).select("p_partkey", U.count_of(F.lower("text")).alias("n"))


_HAS = ", ".join(f"regexp_matches(t, '(?i){_q(p)}') AS {name}" for name, p in U.SCOPES.items())


@R.query(
    "str18_scope_type",
    rf"""WITH line AS ({DESCRIBED}), seen AS (SELECT p_partkey, upper(trim(coalesce(unit, ''))) AS u, {_HAS}, least(5, len(list_filter(regexp_split_to_array(regexp_extract(t, '(?i){_q(U.INCLUDED)}', 1), '[,&]|\band\b'), lambda x: length(trim(x)) > 2))) AS components FROM (SELECT *, lower(coalesce(text, '')) AS t FROM line)),
named AS (SELECT *, CASE WHEN installation THEN 'INSTALLATION_BUNDLE' WHEN maintenance THEN 'MAINTENANCE_BUNDLE' WHEN service AND NOT accessory AND NOT configured THEN 'SERVICE' WHEN bulk OR u IN ('TON', 'CUYD', 'GAL', 'MFT', 'SQFT', 'LNFT') THEN 'BULK_COMMODITY'
 WHEN accessory AND NOT configured THEN 'ACCESSORY_OR_PART' WHEN configured OR components >= 2 THEN 'CONFIGURED_PRODUCT' ELSE 'BARE_PRODUCT' END AS scope FROM seen)
SELECT p_partkey, scope, CASE scope WHEN 'BULK_COMMODITY' THEN 1 WHEN 'ACCESSORY_OR_PART' THEN 0 WHEN 'CONFIGURED_PRODUCT' THEN 3 WHEN 'BARE_PRODUCT' THEN 2 ELSE 4 END AS level, components, CASE WHEN scope = 'BARE_PRODUCT' THEN 'MEDIUM' ELSE 'HIGH' END AS scope_confidence,
 CASE WHEN configured OR accessory OR installation OR maintenance OR service THEN 'HIGH' ELSE 'MEDIUM' END AS level_confidence, service::INT AS service, installation::INT AS installation, maintenance::INT AS maintenance, warranty::INT AS warranty, accessory::INT AS accessory, capacity::INT AS capacity FROM named""",
)
def str18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope, level and indicators of all lines."""
    return described(spark, sf_dir).select("p_partkey", U.scope_of(F.col("text"), F.col("unit")).alias("s")).select("p_partkey", "s.*")


_FRACTION = " ".join(f"WHEN '{k}' THEN {v}" for k, v in U.FRACTIONS.items())


def _n(name: str) -> str:
    hit = f"nullif(regexp_extract(text, '(?i){_q(U.SPECS[name])}', 1), '')"
    if name == "voltage":
        hit = f"split_part({hit}, '/', 1)"
    return rf"coalesce(CASE trim({hit}) {_FRACTION} END, TRY_CAST(nullif(regexp_extract({hit}, '(\d+(?:\.\d+)?)', 1), '') AS DOUBLE)) AS {name}"


def _u(name: str) -> str:
    return f"upper(regexp_extract(text, '(?i){_q(U.SPECS[name])}', 2)) AS {name}_unit"


_SPEC_READ = ", ".join([*(_n(n) for n in U.SPECS if n not in ("ssd", "hdd", "poe", "phase")), *(_u(n) for n in ("storage", "speed", "power")), *(f"regexp_matches(text, '(?i){_q(U.SPECS[n])}') AS {n}" for n in ("ssd", "hdd", "poe")), f"upper(nullif(regexp_extract(text, '(?i){_q(U.SPECS['phase'])}', 1), '')) AS phase_word"])
_MATERIAL = " ".join(f"WHEN regexp_matches(text, '(?i){_q(p)}') THEN '{m}'" for p, m in U.MATERIALS)
SPEC_SQL = f"""SELECT p_partkey, coalesce(given, CASE WHEN ram BETWEEN 1 AND 512 THEN ram END) AS ram_gb, CASE storage_unit WHEN 'TB' THEN nullif(storage, 0) * 1024 WHEN 'MB' THEN nullif(storage, 0) / 1024 ELSE nullif(storage, 0) END AS storage_gb,
 CASE WHEN ssd THEN 1.0::DOUBLE WHEN hdd THEN 0.0 END AS is_ssd, CASE WHEN ports IN (4, 8, 12, 16, 24, 48, 52, 96) THEN ports END AS ports, CASE speed_unit WHEN 'MBPS' THEN nullif(speed, 0) / 1000 WHEN '10GBE' THEN CASE WHEN speed <> 0 THEN 10.0 END ELSE nullif(speed, 0) END AS speed_gbps,
 CASE WHEN poe THEN 1.0::DOUBLE END AS is_poe, CASE WHEN voltage BETWEEN 12 AND 34500 THEN voltage END AS voltage_v, CASE WHEN power_unit IN ('KW', 'KVA') THEN nullif(power, 0) * 1000 ELSE nullif(power, 0) END AS power_w, CASE WHEN hp BETWEEN 0.1 AND 5000 THEN hp END AS horsepower_hp,
 CASE WHEN phase_word IN ('1', 'SINGLE') THEN 1.0::DOUBLE WHEN phase_word IS NOT NULL THEN 3.0 END AS phase, lumens, CASE WHEN pipe BETWEEN 0.125 AND 96 THEN pipe END AS pipe_diameter_in, CASE WHEN psi BETWEEN 50 AND 10000 THEN psi ELSE class END AS pressure_psi, schedule, material, gpm AS flow_gpm
 FROM (SELECT p_partkey, CASE WHEN p_partkey % 29 = 0 THEN p_size::DOUBLE END AS given, CASE {_MATERIAL} END AS material, {_SPEC_READ} FROM line)"""


@R.query("str20_specifications", f"WITH line AS ({DESCRIBED}) {SPEC_SQL}")
def str20(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen specifications of all texts; some lines bring their memory as a column."""
    none = F.lit(None).cast("double")
    found = U.specifications(F.col("text"), F.when(F.col("p_partkey") % 29 == 0, F.col("p_size").cast("double")), none, none, none)
    return described(spark, sf_dir).select("p_partkey", *[c.alias(n) for n, c in found.items()])


_BOX, _ONE = ", ".join(f"'{u}'" for u in U.CONTAINERS), ", ".join(f"'{u}'" for u in U.PIECES)


@R.query(
    "mth8_base_price",
    f"""WITH {UNIT_CTE}, {PACK_CTE}, {RECORD_CTE}, judged AS (SELECT *, CASE WHEN p_partkey % 31 = 0 THEN 100.0 ELSE price END AS raw, CASE WHEN unit IN ({_BOX}) THEN 'COMMERCIAL_UNIT' WHEN unit IN ({_ONE}) THEN CASE WHEN pack > 1 AND confidence = 'HIGH' THEN 'COMMERCIAL_UNIT' ELSE 'BASE_UNIT' END WHEN bulk = 1 THEN 'BASE_UNIT' ELSE 'UNKNOWN' END AS basis,
 CASE WHEN unit IN ({_BOX}) THEN CASE WHEN pack <= 1 THEN 'MEDIUM' WHEN confidence IN ('HIGH', 'MEDIUM') THEN confidence ELSE 'LOW' END WHEN unit IN ({_ONE}) THEN CASE WHEN pack > 1 AND confidence = 'HIGH' THEN 'MEDIUM' ELSE 'HIGH' END WHEN bulk = 1 THEN 'HIGH' ELSE 'LOW' END AS trust FROM record)
SELECT p_partkey, basis, trust AS basis_confidence, {s4("CASE WHEN basis = 'COMMERCIAL_UNIT' AND pack > 1 AND trust <> 'LOW' THEN raw / pack ELSE raw END")} AS base_price, CASE WHEN basis = 'COMMERCIAL_UNIT' AND pack > 1 AND trust <> 'LOW' THEN trust WHEN basis = 'BASE_UNIT' THEN 'HIGH' ELSE 'LOW' END AS price_confidence FROM judged""",
)
def mth8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price basis and price of a base unit of all lines; some lines have no price."""
    line = U.commercial_record(F.col("unit"), F.col("unit_text"), F.col("text")).alias("r")
    rows = described(spark, sf_dir).select("p_partkey", F.when(F.col("p_partkey") % 31 != 0, F.col("price")).alias("price"), line)
    basis, trust = U.price_basis(F.col("r"))
    price, sure = U.base_price(F.col("price"), F.col("r"))
    return rows.select("p_partkey", basis.alias("basis"), trust.alias("basis_confidence"), q4(price).alias("base_price"), sure.alias("price_confidence"))


@R.query(
    "mth7_pack_ratio",
    f"""WITH {UNIT_CTE}, {PACK_CTE}, {RECORD_CTE}, pair AS (SELECT a.p_partkey, a.unit AS qu, b.unit AS cu, a.base AS qb, b.base AS cb, a.kind AS qk, b.kind AS ck, greatest(a.pack, 0.001) AS qp, greatest(b.pack, 0.001) AS cp FROM record a JOIN record b ON b.p_partkey = a.p_partkey + 1)
SELECT p_partkey, (qu = cu AND qu <> 'UNKNOWN')::INT AS same_unit, (qb = cb AND qb <> 'OTHER')::INT AS same_base, (qk = ck AND qk <> 'OTHER')::INT AS same_kind, (abs(qp - cp) < 0.001)::INT AS same_pack, {s4('qp / cp')} AS ratio, {s4('ln(qp / cp)')} AS log_ratio, abs(qp - cp) AS difference,
 ((qp > 1 AND cp <= 1) OR (qp <= 1 AND cp > 1))::INT AS cross_packaging, (qp > 3 * cp OR cp > 3 * qp)::INT AS severe, {s4('1 / (1 + abs(ln(qp / cp)))')} AS consistency FROM pair""",
)
def mth7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit and pack comparison of each line with the next part's."""
    line = U.commercial_record(F.col("unit"), F.col("unit_text"), F.col("text")).alias("r")
    rows = described(spark, sf_dir).select("p_partkey", line)
    pair = rows.select("p_partkey", F.col("r").alias("q")).join(rows.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("r").alias("c")), "p_partkey")
    a, b = F.greatest("q.pack", F.lit(0.001)), F.greatest("c.pack", F.lit(0.001))
    off = F.log(a / b)

    def flag(test):
        return test.cast("int")

    return pair.select(
        "p_partkey",
        flag((F.col("q.unit") == F.col("c.unit")) & (F.col("q.unit") != "UNKNOWN")).alias("same_unit"),
        flag((F.col("q.base") == F.col("c.base")) & (F.col("q.base") != "OTHER")).alias("same_base"),
        flag((F.col("q.kind") == F.col("c.kind")) & (F.col("q.kind") != "OTHER")).alias("same_kind"),
        flag(F.abs(a - b) < 0.001).alias("same_pack"),
        q4(a / b).alias("ratio"),
        q4(off).alias("log_ratio"),
        F.abs(a - b).alias("difference"),
        flag(((a > 1) & (b <= 1)) | ((a <= 1) & (b > 1))).alias("cross_packaging"),
        flag((a > 3 * b) | (b > 3 * a)).alias("severe"),
        q4(1 / (1 + F.abs(off))).alias("consistency"),
    )


QUERIES, ORACLES = R.queries, R.oracles
