"""Listings of the test tables written out as pages and notes of every kind that the library reads.

The queries read them back, and their SQL states what must come out from the listings themselves.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Words that a listing's codes are written as; the parsers must find the codes again.
ORIENTATION_WORDS = {"N": "北", "NE": "北東", "E": "東", "SE": "南東", "S": "南", "SW": "南西", "W": "西", "NW": "北西"}
STRUCTURE_WORDS = {"wood": "木造", "light_steel": "軽量鉄骨造", "steel": "鉄骨造", "rc": "ＲＣ造", "src": "鉄骨鉄筋コンクリート"}
PREFECTURE_WORDS = {"saitama": "埼玉県", "tokyo": "東京都", "chiba": "千葉県", "kanagawa": "神奈川県", "osaka": "大阪府"}
MUNICIPALITY_WORDS = {"saitama": "熊谷市", "tokyo": "昭島市", "chiba": "銚子市", "kanagawa": "秦野市", "osaka": "枚方市"}
KIND_WORDS = {0: "マンション", 1: "アパート", 2: "一戸建て"}


def word(table: dict, c: Column, default: str = "-") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(v) for pair in table.items() for v in pair)), c), F.lit(default))


def _said() -> dict[str, Column]:
    age = F.col("listing_id") % 45
    return {
        "id": F.col("listing_id").cast("string"),
        "man": F.format_string("%.1f", F.round(F.col("rent_yen") / 1000) / 10),
        "rent": F.col("rent_yen").cast("string"),
        "fee": F.format_number("mgmt_fee_yen", 0),
        "plain_fee": F.col("mgmt_fee_yen").cast("string"),
        "area": F.col("area_sqm").cast("string"),
        "more_area": (F.col("area_sqm") + 1).cast("string"),
        "walk": F.col("station_walk_min").cast("string"),
        "more_walk": (F.col("station_walk_min") + 2).cast("string"),
        "station": F.concat(F.lit("S"), F.regexp_extract("nearest_station_name", "\\d+", 0)),
        "age": F.when(age == 0, "新築").otherwise(F.concat(F.lit("築"), age, F.lit("年"))),
        "floor": (1 + F.col("listing_id") % 8).cast("string"),
        "layout": F.col("layout_type"),
        "facing": word(ORIENTATION_WORDS, F.col("orientation")),
        "structure": word(STRUCTURE_WORDS, F.col("building_structure")),
        "kind": word(KIND_WORDS, (F.col("listing_id") % 3).cast("int")),
        "bath": F.when(F.col("bathroom_toilet_separate"), "バス・トイレ別").otherwise("ユニットバス"),
        "prefecture": word(PREFECTURE_WORDS, F.col("prefecture")),
        "municipality": word(MUNICIPALITY_WORDS, F.col("prefecture")),
        "built": F.col("building_built_year").cast("string"),
    }


def filled(template: str) -> Column:
    """A template whose ``{names}`` are those of ``_said``."""
    said = _said()
    parts = template.replace("}", "{").split("{")
    return F.concat(*(F.lit(p) if i % 2 == 0 else said[p] for i, p in enumerate(parts)))


CASSETTE = (
    '<section class="cassette_item build"><span class="icn_typeB">賃貸{kind}</span><table><tr><th>築年</th><td>{age}</td></tr><tr><th>構造</th><td>{structure}</td></tr></table>'
    '<p>みどり線/{station}駅 徒歩{more_walk}分 あお線/{station}駅 徒歩{walk}分</p><table><tbody data-detailurl="/room/{id}/1"><tr><td class="price">{man}万円<br>{fee}円</td><td>{floor}階</td><td>{facing}向き</td></tr>'
    '<input type="hidden" value="{rent}" class="chinRyo"><input class="madori" value="{layout}"><input value="{area}" class="senMenseki"><input value="{station}" class="ekiName"><input value="{more_walk}" class="ekiToho"></tbody>'
    '<tbody data-detailurl="https://other.example/room/{id}/2"><tr><td>{man}万円</td><td>{more_area}m2</td></tr></tbody></table></section>'
)
BLOCK = "{age} {station}駅 歩{more_walk}分 新{station}駅 歩{walk}分 {structure} {bath} {floor}階 {man}万円 {plain_fee}円 {area}m2 {facing} {layout} 9階 {man}万円 60000円 {more_area}㎡"
LINES = "<div>所在地 {prefecture}{municipality}</div><div>交通 みどり線 {station}駅 徒歩{walk}分</div><p>築年数 {age}</p><script>1万円</script><p>敷金 9万円</p><p>{man}万円 / {fee}円</p><p>{layout} {area}m²</p><p>主要採光面 {facing}</p><p>{structure}</p><p>{bath}</p>"
DETAIL = (
    '<table><tr><th>所在地</th><td>{prefecture}{municipality}本町3</td></tr><tr><th>交通</th><td>みどり線/{station}駅 歩{walk}分</td></tr><tr><th>間取り</th><td>{layout}</td></tr><tr><th>専有面積</th><td>{area}m²</td></tr>'
    "<tr><th>向き</th><td>{facing}</td></tr><tr><th>建物<span>構造</span></th><td>{structure}</td></tr><tr><th>築年月</th><td>{built}年3月</td></tr><tr><td>賃料</td><td>{man}万円</td></tr><tr><td>管理費</td><td>{fee}円</td></tr></table><p>{bath}</p>"
)
LINKED = '<script type="application/ld+json">{"offers": {"price": "%s"}, "floorSize": {"value": %s}}</script>'
NOTES = "# Listing {id}\nfirst words\n## Reasons to move\nreason {id}\n\n### Detail\nmore of {layout}\n"
STRENGTHS = "## Strengths\nnear {station}\n## More strengths\nfloor {floor}\n"
PLAN = "## The plan\nplan {id}\n"
#: What the notes are asked about: key, pattern of the title, whether it may repeat.
QUESTIONS = [("reason", "Reasons", False), ("strong", "(?i)strengths", True), ("plan", "plan", False)]


def pages(subjects: DataFrame, template: str, *keep: str) -> DataFrame:
    """(``listing_id``, ``url``, ``html``, and the columns ``keep``)."""
    return dealt(subjects).select("listing_id", F.col("listing_id").cast("string").alias("url"), *keep, written(filled(template)).alias("html"))


def written(page: Column) -> Column:
    """The page as the row of a generator: what readers ask of it is asked once, of the page that is made, and not where listings are joined, before they are dealt."""
    return F.explode(F.array(page))


def dealt(subjects: DataFrame) -> DataFrame:
    """Listings over all cores: they come from one small file, and become pages of many times their size."""
    return subjects.repartition(subjects.sparkSession.sparkContext.defaultParallelism, "listing_id")


def detail_pages(subjects: DataFrame) -> DataFrame:
    """Every second page states rent and area as linked data, too; one in seven is a test for bots."""
    linked = F.format_string(LINKED, F.col("rent_yen").cast("string"), F.col("area_sqm").cast("string"))
    html = F.concat(F.when(F.col("listing_id") % 2 == 0, linked).otherwise(""), filled(DETAIL), F.when(F.col("listing_id") % 7 == 0, '<div id="challenge-container"></div>').otherwise(""))
    return dealt(subjects).select("listing_id", F.col("listing_id").cast("string").alias("url"), written(html).alias("html"))


def notes(subjects: DataFrame) -> DataFrame:
    """(``doc``, ``text``): Markdown in which every second listing lacks strengths and every third has a plan."""
    has = lambda n, part: F.when(F.col("listing_id") % n == 0, filled(part)).otherwise("")
    return dealt(subjects).select(F.col("listing_id").alias("doc"), F.concat(filled(NOTES), has(2, STRENGTHS), has(3, PLAN)).alias("text"))


#: A schema that uses every keyword, and payloads that offend against it.
SCHEMA = {
    "type": "object",
    "allOf": [{"if": {"properties": {"prefecture": {"const": "tokyo"}}}, "then": {"properties": {"area_sqm": {"minimum": 20}}}}],
    "required": ["building_structure"],
    "properties": {
        "prefecture": {"$ref": "#/definitions/place"},
        "layout_type": {"enum": ["1R", "1K"]},
        "area_sqm": {"type": ["number", "null"], "minimum": 15, "maximum": 40},
        "rent_yen": {"type": "integer"},
        "stations": {"type": "array", "minItems": 1, "maxItems": 2, "items": {"type": "string", "minLength": 3}},
        "building_structure": {"type": "string", "pattern": "^[a-z]+$"},
    },
    "additionalProperties": False,
    "definitions": {"place": {"type": "string", "minLength": 6}},
}


def payloads(subjects: DataFrame) -> DataFrame:
    """(``listing_id``, ``payload``): listings as JSON texts, some of them faulty."""
    n = F.col("listing_id")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = {
        "prefecture": quoted(F.col("prefecture")),
        "layout_type": quoted(F.col("layout_type")),
        "area_sqm": F.when(n % 13 == 0, "null").otherwise(F.col("area_sqm").cast("string")),
        "rent_yen": F.when(n % 12 == 0, quoted(F.col("rent_yen").cast("string"))).otherwise(F.col("rent_yen").cast("string")),
        "stations": F.concat(F.lit("["), F.array_join(F.array_repeat(F.lit('"S10"'), (n % 4).cast("int")), ","), F.lit("]")),
        "building_structure": F.when(n % 9 != 0, quoted(F.col("building_structure"))),
        "extra": F.when(n % 10 == 0, "1"),
    }
    said = F.array_compact(F.array(*(F.concat(F.lit(f'"{k}":'), v) for k, v in pairs.items())))
    return dealt(subjects).select("listing_id", F.when(n % 50 == 49, "no json").otherwise(F.concat(F.lit("{"), F.array_join(said, ","), F.lit("}"))).alias("payload"))


#: Documents of a bundle: the texts of its parts, with what takes the place of ``@n`` in every n-th bundle and in others.
BUNDLE = {
    "S1": '{"fields":[{"key":"rent"},{"key":"area"},{"key":"@5"}],"mvp_required_fields":["rent","@4"]}',
    "S2": '{"features":[{"input_key":"@3"}],"risk_flag_rules":[{"when":{">":[{"var":"@6"},1]},"outputs":{"risk_flag_id":"DEAR","severity":"@7"}}],"what_if_rules":[{"enabled_if":@8}],"grade_thresholds":{"overall":[{"grade":"A"},{"grade":"@9"}]}}',
    "C1": '{"placeholders":["{rent}","{@10}"],"rules":[{"when":{"==":[{"var":["@11",0]},1]},"summary":"for {rent} and {area}"}]}',
    "D1": '{"coverage":{"prefectures":["tokyo"]},"fallback_policy":[{"benchmark_confidence":"@12"}]}',
    "V0": '{"keys":{"input":{"rent":1,"area":1,"walk":1},"derived":{"multiple":1},"scoring":{},"grades":{}},"enums":{"severity":["high","low"],"grade":["A","B"],"prefecture":["tokyo"],"benchmark_confidence":["low","high"]},"report_placeholders":["{rent}","{area}"],"risk_flags":[{"id":"DEAR"}]}',
}
FAULTS = {3: ("unknown", "multiple"), 4: ("ghost", "area"), 5: ("qa_notes", "walk"), 6: ("nobody", "rent"), 7: ("huge", "high"), 8: ('"text"', '{"var":"area"}'), 9: ("Z", "B"), 10: ("odd", "area"), 11: ("runtime", "rent"), 12: ("sure", "low")}


def bundles(numbers: DataFrame, key: str) -> DataFrame:
    """(``bundle``, ``part``, ``document``): a bundle for each number."""
    def written(text: str) -> Column:
        out = F.lit(text)
        for n in sorted(FAULTS, reverse=True):
            out = F.replace(out, F.lit(f"@{n}"), F.when(F.col(key) % n == 0, FAULTS[n][0]).otherwise(FAULTS[n][1]))
        return out

    parts = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), written(t).alias("document")) for p, t in BUNDLE.items())))
    return numbers.select(F.col(key).cast("string").alias("bundle"), parts.alias("p")).select("bundle", "p.part", "p.document")


#: Two bundles with rules of their own, as their documents stand in files.
RULE_BUNDLES = {
    "plain": {
        "S1": '{"fields":[{"key":"area_sqm"}]}',
        "S2": """{"weights":{"location":0.5,"condition":0.3,"cost":0.2},
          "grade_thresholds":{"overall":[{"grade":"A","min_score":70},{"grade":"B","min_score":50}],"location":[{"grade":"A","min_score":60}],"cost":[{"grade":"B","min_score":40}]},
          "features":[{"component":"location","input_key":"station_walk_min","method":"bucket","weight":1,"params":{"buckets":[{"max":10,"score":90},{"max":20,"score":60}],"default_score":30}},
            {"component":"condition","input_key":"area_sqm","method":"linear","weight":0.5,"params":{"min_x":10,"max_x":50,"min_score":20,"max_score":100,"clamp":true}},
            {"component":"condition","input_key":"bathroom_toilet_separate","method":"boolean","weight":0.5,"params":{"true_score":80,"false_score":40}},
            {"component":"cost","input_key":"rent_delta_ratio","method":"bucket","weight":1,"params":{"buckets":[{"max":0,"score":80}],"default_score":20,"confidence_key":"benchmark_confidence","neutral_score_if_confidence_in":["none"],"neutral_score":50}}],
          "risk_flag_rules":[{"id":"r2","priority":20,"when":{"<":[{"var":"area_sqm"},20]},"outputs":{"risk_flag_id":"SMALL","severity":"low"}},{"id":"r1","priority":10,"when":{">":[{"var":"station_walk_min"},20]},"outputs":{"risk_flag_id":"FAR","severity":"mid"}}],
          "tradeoff_rules":[{"id":"t1","priority":1,"when":{">=":[{"var":"location_score"},90]},"outputs":{"tradeoff_tag":"near"}},{"id":"t2","priority":2,"when":{"==":[1,1]},"outputs":{"tradeoff_tag":"even"}}]}""",
        "C1": """{"rules":[{"id":"ANY","priority":0,"when":{"==":[1,1]},"summary_ko":"등급 {overall_grade}","summary_ja":"評価 {overall_grade}","alternative_search_queries_ja":["{layout_type} 賃貸","{nearest_station_name} 徒歩{station_walk_min}分"]},
          {"id":"SMALL","priority":5,"when":{"<":[{"var":"area_sqm"},20]},"summary_ko":"작은 방 {layout_type}","evidence_bullets_ko":["도보 {station_walk_min}분"],"negotiation_suggestions_ja":["礼金の相談"]}]}""",
    },
    "strict": {
        "S1": '{"fields":[{"key":"area_sqm"}]}',
        "S2": """{"weights":{"location":0.2,"condition":0.2,"cost":0.6},"grade_thresholds":{"overall":[{"grade":"A","min_score":90},{"grade":"C","min_score":30}]},
          "features":[{"component":"location","input_key":"station_walk_min","method":"linear","weight":1,"params":{"min_x":0,"max_x":30,"min_score":0,"max_score":100,"clamp":true,"direction":"lower_is_better"}},
            {"component":"condition","input_key":"orientation","method":"lookup","weight":1,"params":{"table":{"S":100,"N":10},"default_score":55}},
            {"component":"cost","input_key":"monthly_fixed_cost_yen","method":"bucket","weight":1,"params":{"buckets":[{"max":20000,"score":95},{"min":60000,"score":5}],"default_score":45}}],
          "risk_flag_rules":[{"id":"r","priority":1,"when":{"and":[{"!=":[{"var":"contract_term_months"},null]},{">=":[{"var":"contract_term_months"},12]}]},"outputs":{"risk_flag_id":"LONG","severity":"high"}}]}""",
        "C1": '{"rules":[{"id":"DEAR","priority":1,"when":{">":[{"var":"rent_yen"},40000]},"summary_ja":"家賃 {rent_yen} 円"}]}',
    },
}


#: Addresses, ways and links of a listing, as texts.
ADDRESS = "〒000 {prefecture}{municipality}本町3-1"
ACCESS = "みどり線 {station}駅 徒歩{more_walk}分 / あお線 新 {station}駅 歩{walk}分"


def encoded(said: Column, name: Column) -> Column:
    """Texts as bytes in the encoding that is named beside each."""

    @F.arrow_udf(T.BinaryType())
    def to_bytes(texts: pa.Array, names: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.encode(n) for t, n in zip(texts.to_pylist(), names.to_pylist())], pa.binary())

    return to_bytes(said, name)
