"""DuckDB SQL of the registered queries, written on its own: no pattern, word, score or
label here comes from the library's constants. ``\\p{Nd}`` and classes stand where the
library says \\d, \\s and \\w, which are ASCII in this dialect."""

from __future__ import annotations

from maskwell.plans import fixtures

WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
EDGE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}]+"
N = r"\p{Nd}"
ASCII_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
EMAIL = ASCII_EMAIL + r"|[぀-ゟ゠-ヿ一-鿿\pL\pN_.%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
US_PHONES = [rf"\+1-?{N}{{3}}-?{N}{{3}}-?{N}{{4}}", rf"\({N}{{3}}\)[{WHITE}]?{N}{{3}}-{N}{{4}}"]


def quote(s: str | None) -> str:
    if s is None:
        return "NULL"
    return " || chr(10) || ".join("'" + x.replace("'", "''") + "'" for x in s.split("\n"))


def values(rows: list[tuple], names: str) -> str:
    def cell(x) -> str:
        if isinstance(x, list):
            return "[" + ", ".join(map(cell, x)) + "]::VARCHAR[]"
        return "(" + quote(x) + ")" if isinstance(x, str) else "NULL" if x is None else repr(x)

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({names}))"


def corpus(source: str | None = None) -> str:
    """CTEs ``c``(doc_id, text), the documents and fixtures or another source, and ``n``, normalised."""
    c = source or f"c AS (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {values([*fixtures.FIXTURE, (-5, None)], 'doc_id, text')})"
    return f"""
WITH RECURSIVE {c},
n AS (SELECT doc_id, text AS raw, regexp_replace(regexp_replace(regexp_replace(replace(coalesce(text, ''), '　', ' '),
        '[ \\t]{{2,}}', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^{EDGE}|{EDGE}$', '', 'g') AS text FROM c)"""


def plain_spans(entity: str, pattern: str) -> str:
    p = quote(pattern)
    return f"""{corpus()},
m AS (SELECT doc_id, regexp_extract_all(text, {p}) AS hits, string_split_regex(text, {p}) AS gaps FROM n),
s AS (SELECT doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM m),
e AS (SELECT doc_id, hits[i] AS text, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i], '')) AS stop FROM s)
SELECT doc_id, '{entity}' AS entity, (stop - length(text))::BIGINT AS start, stop::BIGINT AS "end", text FROM e"""


HEADINGS = [
    ("contact", ["連絡先", "住所", "基本情報", "個人情報"], ["contact", "personal", "personal information"]),
    ("education", ["学歴"], ["education", "academic"]),
    ("experience", ["職歴", "職務経歴", "経歴", "職務経歴書サマリー"], ["experience", "work experience", "employment", "professional summary"]),
    ("skills", ["スキル", "技術", "技術スキル"], ["skills", "technical skills"]),
    ("certifications", ["資格", "認定"], ["certifications", "licenses"]),
]


def segments(source: str | None = None) -> str:
    cases = " ".join(
        f"WHEN {' OR '.join([f'contains(body, {quote(w)})' for w in ja] + [f'contains(lower(body), {quote(w)})' for w in en])} THEN '{kind}'" for kind, ja, en in HEADINGS
    )
    return f"""{corpus(source)},
x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM n),
o AS (SELECT *, regexp_replace(regexp_replace(line, '^{EDGE}', ''), '{EDGE}$', '') AS body,
        length(line) - length(regexp_replace(line, '^{EDGE}', '')) AS lead,
        coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM x),
k AS (SELECT *, CASE {cases} END AS kind FROM o WHERE body <> ''),
g AS (SELECT doc_id, (row_number() OVER w - 1)::BIGINT AS line_number, (pos + lead)::BIGINT AS start, (pos + lead + length(body))::BIGINT AS "end",
        'section_' || count(kind) OVER w AS section_id, coalesce(last_value(kind IGNORE NULLS) OVER w, 'header') AS section_type, body AS text
      FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


PREFECTURE = rf"(?:東京都|北海道|(?:京都|大阪)府|[^{WHITE}]{{2,3}}県)[^{WHITE}]{{3,30}}"
SUFFIXES = (
    "高等学校|高校|中学校|中学|小学校|小学|大学|大学院|専門学校|学園|学院|株式会社|会社|有限会社|合同会社|法人|銀行|病院|クリニック|事務所|研究所|"
    "センター|協会|組合|財団|社団"
)
#: (order, rule, source, entity, score, pattern, is the span its first group)
DOCUMENT_RULES = [
    (1, "phone_jp", "rule:phone_jp", "PHONE_NUMBER_JP", 0.7, rf"0{N}{{1,4}}-{N}{{1,4}}-{N}{{4}}", False),
    (2, "phone_jp", "rule:mobile_jp", "PHONE_NUMBER_JP", 0.8, rf"0[1-9]0-{N}{{4}}-{N}{{4}}", False),
    (3, "zip_jp", "rule:zip_jp", "JP_ZIP_CODE", 0.6, rf"{N}{{3}}-{N}{{4}}", False),
    (4, "age", "rule:age_sai", "JP_AGE", 0.8, rf"{N}{{1,3}}歳", False),
    (5, "age", "rule:age_sai_short", "JP_AGE", 0.8, rf"{N}{{1,3}}才", False),
    (6, "gender", "rule:gender", "JP_GENDER", 0.7, "(?:男性|女性)", False),
    (10, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"{N}{{4}}/{N}{{1,2}}/{N}{{1,2}}", False),
    (11, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"{N}{{4}}-{N}{{1,2}}-{N}{{1,2}}", False),
    (12, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"{N}{{4}}年{N}{{1,2}}月{N}{{1,2}}日", False),
    (13, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"令和{N}{{1,2}}年{N}{{1,2}}月{N}{{1,2}}日", False),
    (14, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"平成{N}{{1,2}}年{N}{{1,2}}月{N}{{1,2}}日", False),
    (15, "birth_date", "rule:birth_date", "DATE_OF_BIRTH_JP", 1.0, rf"昭和{N}{{1,2}}年{N}{{1,2}}月{N}{{1,2}}日", False),
    (20, "address", "rule:address", "JP_ADDRESS", 0.7, PREFECTURE, False),
    (30, "name_keyword", "rule:name_keyword", "JP_PERSON", 0.85, rf"氏名[:{WHITE}]*([一-龯ぁ-んァ-ン]{{1,5}}[{WHITE}]?[一-龯ぁ-んァ-ン]{{1,5}})", True),
    (31, "name_keyword", "rule:name_keyword", "JP_PERSON", 0.85, rf"ふりがな[:{WHITE}]*([ぁ-ん]{{1,10}}[{WHITE}]?[ぁ-ん]{{1,10}})", True),
    (32, "name_keyword", "rule:name_keyword", "JP_PERSON", 0.85, rf"フリガナ[:{WHITE}]*([ァ-ン]{{1,10}}[{WHITE}]?[ァ-ン]{{1,10}})", True),
    (33, "name_keyword", "rule:name_keyword", "JP_PERSON", 0.85, rf"名前[:{WHITE}]*([一-龯ぁ-んァ-ン]{{1,5}}[{WHITE}]?[一-龯ぁ-んァ-ン]{{1,5}})", True),
    (40, "email", "rule:email", "EMAIL_ADDRESS", 1.0, EMAIL, False),
    (50, "phone_en", "rule:phone_en", "PHONE_NUMBER", 0.9, US_PHONES[0], False),
    (51, "phone_en", "rule:phone_en", "PHONE_NUMBER", 0.9, US_PHONES[1], False),
]
ALL = ["PHONE_NUMBER_JP", "JP_ZIP_CODE", "DATE_OF_BIRTH_JP", "JP_AGE", "JP_GENDER", "EMAIL_ADDRESS", "JP_PERSON", "JP_ADDRESS"]
BIRTH, CAREER = "生年月日|年齢|生まれ|誕生日|生年", "学歴|職歴|職務経歴|入学|卒業|入社|退社|現在"


def found(entities: list[str] | None = None, extra: tuple = (), source: str = "n", rules: list[tuple] | None = None) -> str:
    """CTEs up to ``scored``: all rules' spans (doc_id, text, ord, i, rule, source, entity, score, t, start, stop)."""
    wanted = [r for r in (rules or DOCUMENT_RULES) if entities is None or r[3] in entities] + list(extra)
    return f"""
rules AS {values(wanted, 'ord, rule, source, entity, score, pattern, grp')},
hit AS (SELECT doc_id, text, rules.*, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps FROM {source}, rules WHERE regexp_matches(text, pattern)),
each_hit AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hit),
located AS (SELECT doc_id, text, ord, i, rule, source, entity, score, CASE WHEN grp THEN regexp_extract(hits[i], pattern, 1) ELSE hits[i] END AS t,
        (length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i], '')))::BIGINT AS stop FROM each_hit),
bounded AS (SELECT *, stop - length(t) AS start FROM located),
context AS (SELECT *, substr(text, greatest(start - 50, 0) + 1, start - greatest(start - 50, 0)) AS before50, substr(text, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0)) AS before20,
        substr(text, greatest(start - 50, 0) + 1, stop + 50 - greatest(start - 50, 0)) AS around50, substr(text, greatest(start - 30, 0) + 1, stop + 30 - greatest(start - 30, 0)) AS around30 FROM bounded),
scored AS (SELECT doc_id, text, ord, i, rule, source, entity, t, start, stop,
        CASE WHEN entity = 'JP_ADDRESS' THEN CASE WHEN regexp_matches(around50, '住所|〒|現住所|所在地') THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END
             WHEN (entity = 'PHONE_NUMBER_JP' AND regexp_matches(before50, 'TEL|電話|携帯|自宅|tel|Tel|電話番号'))
               OR (entity = 'JP_ZIP_CODE' AND regexp_matches(before50, '〒|郵便番号|郵便|zip|ZIP|住所'))
               OR (entity = 'JP_AGE' AND regexp_matches(before50, '年齢|生年月日|（|）|歳')) OR (entity = 'JP_GENDER' AND contains(before50, '性別'))
             THEN least(1.0::DOUBLE, score::DOUBLE + 0.35::DOUBLE) ELSE score::DOUBLE END AS score
      FROM context
      WHERE CASE entity WHEN 'DATE_OF_BIRTH_JP' THEN regexp_matches(around50, '{BIRTH}') AND (regexp_matches(before20, '{BIRTH}') OR NOT regexp_matches(around30, '{CAREER}'))
                        WHEN 'JP_ADDRESS' THEN NOT regexp_matches(t, '(?:{SUFFIXES})$')
                        WHEN 'JP_PERSON' THEN length(replace(replace(t, ' ', ''), '　', '')) >= 2 ELSE true END)"""


def meaningful_and_greedy(source: str = "scored", out: str = "span") -> str:
    """CTEs that drop meaningless spans and keep the best of those that overlap."""
    return f"""
{out}_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start, ord, i) AS r FROM {source}
  WHERE regexp_matches(t, '[^{WHITE}\\x{{1C}}-\\x{{1F}}]') AND (entity NOT IN ('PERSON', 'JP_PERSON') OR regexp_matches(t, '[A-Za-z぀-ヿ一-鿿]'))),
{out}_greedy(doc_id, r, kept) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::STRUCT(r BIGINT, s BIGINT, e BIGINT)[] FROM {out}_ranked
  UNION ALL SELECT g.doc_id, x.r, CASE WHEN len(list_filter(g.kept, lambda k: k.s < x.stop AND x.start < k.e)) > 0 THEN g.kept
                                       ELSE list_append(g.kept, {{'r': x.r, 's': x.start, 'e': x.stop}}) END
  FROM {out}_greedy g JOIN {out}_ranked x ON x.doc_id = g.doc_id AND x.r = g.r + 1),
{out}_best AS (SELECT doc_id, unnest(list_transform(kept, lambda k: k.r)) AS r FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM {out}_greedy GROUP BY doc_id)),
{out} AS (SELECT x.* FROM {out}_best JOIN {out}_ranked x USING (doc_id, r))"""


SPAN = 'SELECT doc_id, entity, start::BIGINT AS start, stop::BIGINT AS "end", t AS text, score, source FROM span'
MASKS = "CASE {e} WHEN 'DATE_OF_BIRTH_JP' THEN '****/**/**' WHEN 'JP_ZIP_CODE' THEN '***-****' WHEN 'PHONE_NUMBER_JP' THEN '***-****-****' ELSE '****' END"


def document_spans(entities: list[str] | None = None, extra: tuple = ()) -> str:
    return f"{corpus()},{found(entities or ALL, extra)},{meaningful_and_greedy()}"


def masked(spans: str = "span", out: str = "masked") -> str:
    """CTEs that put masks in place of disjoint spans (doc_id, entity, start, stop)."""
    return f"""
pieces AS (SELECT *, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS since FROM {spans}),
put AS (SELECT doc_id, string_agg(substr(n.text, since + 1, start - since) || {MASKS.format(e='entity')}, '' ORDER BY start) AS body, max(stop) AS last, count(*) AS k
        FROM pieces JOIN n USING (doc_id) GROUP BY doc_id),
{out} AS (SELECT n.doc_id, CASE WHEN body IS NULL THEN n.text ELSE body || substr(n.text, last + 1, length(n.text)) END AS masked, coalesce(k, 0)::BIGINT AS n_entities
        FROM n LEFT JOIN put USING (doc_id))"""


# The line rules: (order, source, entity, score, pattern)
DATE_PATTERNS = [rf"\b{N}{{4}}-{N}{{2}}-{N}{{2}}\b", rf"{N}{{4}}年{N}{{1,2}}月{N}{{1,2}}日", rf"\b{N}{{4}}/{N}{{1,2}}/{N}{{1,2}}\b"]
LINE_RULES = [
    (1, "rule:email_regex", "EMAIL_ADDRESS", 0.95, EMAIL),
    (2, "rule:phone_jp_regex", "PHONE_NUMBER_JP", 0.9, rf"0{N}{{1,4}}-{N}{{1,4}}-{N}{{4}}"),
    (3, "rule:phone_jp_regex", "PHONE_NUMBER_JP", 0.9, rf"0{N}{{9,10}}"),
    (4, "rule:phone_jp_regex", "PHONE_NUMBER_JP", 0.9, rf"\+81-?{N}{{1,4}}-?{N}{{1,4}}-?{N}{{4}}"),
    (5, "rule:phone_en_regex", "PHONE_NUMBER", 0.9, US_PHONES[0]),
    (6, "rule:phone_en_regex", "PHONE_NUMBER", 0.9, US_PHONES[1]),
    (7, "rule:jp_zip_regex", "JP_ZIP_CODE", 0.95, rf"〒?[{WHITE}]*{N}{{3}}-{N}{{4}}"),
    (8, "rule:us_zip_regex", "US_ZIP_CODE", 0.7, rf"\b{N}{{5}}(?:-{N}{{4}})?\b"),
    (9, "rule:date_regex", "DATE", 0.5, DATE_PATTERNS[0]),
    (10, "rule:date_regex", "DATE", 0.5, DATE_PATTERNS[1]),
    (11, "rule:date_regex", "DATE", 0.5, DATE_PATTERNS[2]),
    (12, "rule:age_regex", "JP_AGE", 0.85, rf"{N}{{1,3}}[{WHITE}]*歳"),
    (13, "rule:gender_regex", "JP_GENDER", 0.8, rf"[（(]?[{WHITE}]*(?:男性?|女性?|男|女)[{WHITE}]*[）)]?"),
]
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
PRIORITY = (
    "EMAIL_ADDRESS PHONE_NUMBER_JP PHONE_NUMBER JP_ZIP_CODE US_ZIP_CODE CUSTOMER_ID_JP JP_ADDRESS LOCATION JP_ORGANIZATION JP_PERSON PERSON DATE_OF_BIRTH_JP DATE JP_AGE JP_GENDER"
).split()
STRUCT = "STRUCT(r BIGINT, s BIGINT, e BIGINT, p BIGINT, sc DOUBLE)"


def verified(more: str = "") -> str:
    """CTEs up to ``verdict``: line candidates and ``more`` of them, merged, verified, collisions resolved."""
    digits = "translate({x}, '０１２３４５６７８９', '0123456789')"
    rank = f"coalesce(list_position({PRIORITY!r}, entity) - 1, {len(PRIORITY)})"
    first = "coalesce(list_position(list_transform({k}, lambda k: k.s < x.stop AND x.start < k.e), true), 0)"
    return f"""{segments()},
rules AS {values(LINE_RULES, 'ord, source, entity, score, pattern')},
hit AS (SELECT doc_id, line_number, start AS base, section_type, text, rules.*, regexp_extract_all(text, pattern) AS hits, string_split_regex(text, pattern) AS gaps
        FROM (SELECT * FROM g WHERE regexp_matches(text, '[@男女]|{N}')) g, rules WHERE regexp_matches(text, pattern)),
each_hit AS (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM hit),
located AS (SELECT * EXCLUDE (hits, gaps, pattern), hits[i] AS t, length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i], '')) AS local_stop FROM each_hit),
ruled AS (SELECT doc_id, line_number, section_type, ord, i, source,
        CASE WHEN source = 'rule:date_regex' AND regexp_matches(lower(text), 'birth|生年月日|誕生|生まれ|date of birth') THEN 'DATE_OF_BIRTH_JP' ELSE entity END AS entity,
        CASE WHEN source = 'rule:date_regex' AND regexp_matches(lower(text), 'birth|生年月日|誕生|生まれ|date of birth') THEN 0.9::DOUBLE ELSE score::DOUBLE END AS score, t,
        base + local_stop - length(t) AS start, base + local_stop AS stop
      FROM (SELECT *, local_stop - length(t) AS local FROM located)
      WHERE CASE source
        WHEN 'rule:jp_zip_regex' THEN NOT (regexp_matches((CASE WHEN local > 0 THEN substr(text, local, 1) ELSE '' END), '^{N}$')
          OR (local > 1 AND regexp_matches(substr(text, local - 1, 1), '^{N}$') AND substr(text, local, 1) = '-'))
        WHEN 'rule:us_zip_regex' THEN section_type IN ('contact', 'header') AND NOT try_cast({digits.format(x='t[1:4]')} AS INT) BETWEEN 1900 AND 2100
        WHEN 'rule:age_regex' THEN try_cast({digits.format(x="regexp_extract(t, '" + N + "+')")} AS INT) BETWEEN 0 AND 120
        ELSE true END),
prefecture AS (SELECT unnest({PREFECTURES!r}) AS name, generate_subscripts({PREFECTURES!r}, 1) AS place),
address AS (SELECT doc_id, line_number, section_type, place, name, start AS base, instr(text, name) AS spot,
        regexp_replace(regexp_replace(regexp_extract(substr(text, instr(text, name)), '^(?s:(.*?))(?:\\n|　|  |Email|email|Phone|phone|TEL|tel|$)', 1), '^{EDGE}', ''), '{EDGE}$', '') AS t
      FROM (SELECT * FROM g WHERE regexp_matches(text, '[県府都道]')) g, prefecture WHERE contains(text, name)),
raw_candidate AS (SELECT doc_id, line_number, section_type, ord, i::BIGINT AS i, source, entity, score, t, start::BIGINT AS start, stop::BIGINT AS stop FROM ruled
  UNION ALL SELECT doc_id, line_number, section_type, 20, place, 'rule:jp_address_prefix', 'JP_ADDRESS', 0.75::DOUBLE, t, base + spot - 1, base + spot - 1 + length(t)
            FROM address WHERE length(t) > length(name) + 2 {more}),
candidate AS (SELECT *, ({rank})::BIGINT AS p, row_number() OVER (PARTITION BY doc_id ORDER BY start, {rank}, score DESC, line_number, ord, i) AS r FROM raw_candidate),
merging(doc_id, r, kept) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::{STRUCT}[] FROM candidate
  UNION ALL SELECT m.doc_id, x.r, CASE WHEN {first.format(k='m.kept')} = 0 THEN list_append(m.kept, {{'r': x.r, 's': x.start, 'e': x.stop, 'p': x.p, 'sc': x.score}})
     WHEN x.p < m.kept[{first.format(k='m.kept')}].p OR (x.p = m.kept[{first.format(k='m.kept')}].p AND x.score > m.kept[{first.format(k='m.kept')}].sc)
       THEN list_append(list_filter(m.kept, lambda k, j: j <> {first.format(k='m.kept')}), {{'r': x.r, 's': x.start, 'e': x.stop, 'p': x.p, 'sc': x.score}})
     ELSE m.kept END
  FROM merging m JOIN candidate x ON x.doc_id = m.doc_id AND x.r = m.r + 1),
merged AS (SELECT doc_id, unnest(list_transform(kept, lambda k: k.r)) AS r, generate_subscripts(kept, 1) AS place FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM merging GROUP BY doc_id)),
judged AS (SELECT c.*, place, CASE WHEN section_type IN ('education', 'experience') AND entity IN ('JP_PERSON', 'PERSON') THEN -0.3::DOUBLE
        WHEN section_type IN ('education', 'experience') AND entity IN ('JP_ADDRESS', 'LOCATION') THEN -0.2::DOUBLE
        WHEN section_type = 'contact' AND entity IN ('JP_PERSON', 'PERSON', 'JP_ADDRESS', 'LOCATION') THEN 0.2::DOUBLE ELSE 0 END AS shift,
        regexp_replace(regexp_replace(t, '^{EDGE}', ''), '{EDGE}$', '') AS body FROM merged JOIN candidate c USING (doc_id, r)),
shaped AS (SELECT *, CASE WHEN shift = 0 THEN score ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, score + shift)) END AS moved,
        CASE entity WHEN 'EMAIL_ADDRESS' THEN 'email' WHEN 'PHONE_NUMBER_JP' THEN 'phone_jp' WHEN 'PHONE_NUMBER' THEN 'phone_en' WHEN 'JP_ZIP_CODE' THEN 'jp_zip'
          WHEN 'US_ZIP_CODE' THEN 'us_zip' WHEN 'DATE' THEN 'date' WHEN 'DATE_OF_BIRTH_JP' THEN 'date' END AS form,
        CASE entity WHEN 'EMAIL_ADDRESS' THEN regexp_full_match(body, {quote(EMAIL)})
          WHEN 'PHONE_NUMBER_JP' THEN regexp_full_match(replace(replace(body, ' ', ''), '　', ''), {quote(rf'0{N}{{1,4}}-?{N}{{1,4}}-?{N}{{4}}|\+81-?{N}{{1,4}}-?{N}{{1,4}}-?{N}{{4}}')})
          WHEN 'PHONE_NUMBER' THEN regexp_full_match(replace(body, ' ', ''), {quote('|'.join(US_PHONES))})
          WHEN 'JP_ZIP_CODE' THEN regexp_full_match(body, {quote(rf'〒?[{WHITE}]*{N}{{3}}-{N}{{4}}')}) WHEN 'US_ZIP_CODE' THEN regexp_full_match(body, {quote(rf'{N}{{5}}(-{N}{{4}})?')})
          WHEN 'DATE' THEN NULL WHEN 'DATE_OF_BIRTH_JP' THEN NULL ELSE true END AS fits,
        regexp_extract({digits.format(x='body')}, '^([0-9]{{4}})(?:-([0-9]{{2}})-([0-9]{{2}})|年([0-9]{{1,2}})月([0-9]{{1,2}})日|/([0-9]{{1,2}})/([0-9]{{1,2}}))', ['y', 'a', 'b', 'c', 'd', 'e', 'f']) AS d FROM judged),
checked AS (SELECT *, coalesce(fits, coalesce(try_cast(d.y AS INT) BETWEEN 1900 AND 2100 AND try_cast(d.a || d.c || d.e AS INT) BETWEEN 1 AND 12 AND try_cast(d.b || d.d || d.f AS INT) BETWEEN 1 AND 31, false)) AS ok FROM shaped),
decided AS (SELECT *, CASE WHEN NOT ok THEN 'exclude' WHEN moved >= 0.7 THEN 'mask' WHEN moved >= 0.5 THEN 'review' ELSE 'exclude' END AS status, CASE WHEN ok THEN moved ELSE 0.0::DOUBLE END AS verified,
        concat_ws('; ', CASE WHEN shift < 0 THEN 'section_penalty:' || section_type WHEN shift > 0 THEN 'section_boost:' || section_type END,
          CASE WHEN form IS NOT NULL THEN CASE WHEN ok THEN 'format_valid:' ELSE 'format_invalid:' END || form END) AS reasons FROM checked),
active AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, place) AS q FROM decided WHERE status <> 'exclude'),
colliding(doc_id, q, kept) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::{STRUCT}[] FROM active
  UNION ALL SELECT m.doc_id, x.q, CASE WHEN {first.format(k='m.kept')} = 0 THEN list_append(m.kept, {{'r': x.r, 's': x.start, 'e': x.stop, 'p': x.p, 'sc': x.score}})
     WHEN x.p < m.kept[{first.format(k='m.kept')}].p THEN list_append(list_filter(m.kept, lambda k, j: j <> {first.format(k='m.kept')}), {{'r': x.r, 's': x.start, 'e': x.stop, 'p': x.p, 'sc': x.score}})
     ELSE m.kept END
  FROM colliding m JOIN active x ON x.doc_id = m.doc_id AND x.q = m.q + 1),
winner AS (SELECT doc_id, unnest(list_transform(kept, lambda k: k.r)) AS r, true AS won FROM (SELECT doc_id, arg_max(kept, q) AS kept FROM colliding GROUP BY doc_id)),
verdict AS (SELECT d.doc_id, entity, start::BIGINT AS start, stop::BIGINT AS "end", t AS text, score, source, section_type AS section,
        CASE WHEN status = 'exclude' OR won THEN verified ELSE 0.0::DOUBLE END AS verified, CASE WHEN status = 'exclude' OR won THEN status ELSE 'exclude' END AS status,
        CASE WHEN status <> 'exclude' AND won IS NULL THEN 'collision_lower_priority' WHEN reasons = '' THEN 'passed_verification' ELSE reasons END AS reason
      FROM decided d LEFT JOIN winner USING (doc_id, r))"""


SINGLE = {
    "email_spans": ("EMAIL_ADDRESS", ASCII_EMAIL),
    "us_phone_spans": ("PHONE_NUMBER", US_PHONES[1]),
    "us_phone_plus_spans": ("PHONE_NUMBER", US_PHONES[0]),
    "jp_phone_spans": ("PHONE_NUMBER_JP", rf"0{N}{{1,4}}-{N}{{1,4}}-{N}{{4}}"),
    "jp_zip_spans": ("JP_ZIP_CODE", rf"{N}{{3}}-{N}{{4}}"),
    "age_spans": ("JP_AGE", rf"{N}{{1,3}}歳"),
    "gender_spans": ("JP_GENDER", "(?:男性|女性)"),
    "date_slash_spans": ("DATE", rf"{N}{{4}}/{N}{{1,2}}/{N}{{1,2}}"),
    "date_kanji_spans": ("DATE", rf"{N}{{4}}年{N}{{1,2}}月{N}{{1,2}}日"),
}
STAMP = "2024-01-02 03:04:05"
LOG_LINE = "printf('[%s] \"%s\" (score: %.2f, pos: %d-%d)', entity, t, score, start, stop)"


def _merged_languages() -> str:
    """Rules of English, then of Japanese; positions covered by better results count once."""
    asked = [*ALL, "JP_ORGANIZATION", "CUSTOMER_ID_JP", "PHONE_NUMBER"]
    english = [(100 + r[0], *r[1:]) for r in DOCUMENT_RULES if r[3] in ("EMAIL_ADDRESS", "PHONE_NUMBER")]
    japanese = [(200 + r[0], *r[1:]) for r in DOCUMENT_RULES if r[3] != "PHONE_NUMBER"]
    return f"""{corpus()},{found(asked, rules=english + japanese)},
listed AS (SELECT * FROM scored WHERE t NOT IN ('help@example.com', 'taro@example.com')),
merge_ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, start - stop, start, ord, i) AS r FROM listed),
merge_step(doc_id, r, kept, covered) AS (
  SELECT DISTINCT doc_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM merge_ranked
  UNION ALL SELECT m.doc_id, x.r,
    CASE WHEN len(list_intersect(m.covered, range(x.start, x.stop))) > (x.stop - x.start) * 0.5 THEN m.kept ELSE list_append(m.kept, x.r) END,
    CASE WHEN len(list_intersect(m.covered, range(x.start, x.stop))) > (x.stop - x.start) * 0.5 THEN m.covered ELSE list_distinct(list_concat(m.covered, range(x.start, x.stop))) END
  FROM merge_step m JOIN merge_ranked x ON x.doc_id = m.doc_id AND x.r = m.r + 1),
merged AS (SELECT x.* EXCLUDE (r, ord), x.start AS ord FROM (SELECT doc_id, unnest(kept) AS r FROM (SELECT doc_id, arg_max(kept, r) AS kept FROM merge_step GROUP BY doc_id)) JOIN merge_ranked x USING (doc_id, r)),
{meaningful_and_greedy('merged')}"""


def _audit() -> str:
    return f"""{corpus()},{found([*ALL, 'PHONE_NUMBER'])},
spoken AS (SELECT *, CASE WHEN regexp_matches(text, '[ぁ-んァ-ン一-龯]') THEN 'ja' ELSE 'en' END AS language FROM scored),
heard AS (SELECT * FROM spoken WHERE rule = 'email' OR (language = 'en') = (rule = 'phone_en'))
SELECT doc_id, language, (row_number() OVER (PARTITION BY doc_id ORDER BY start, score DESC, rule, stop, entity, t) - 1)::BIGINT AS ord, rule AS recognizer, entity, score,
  start::BIGINT AS start, stop::BIGINT AS "end", replace(t, chr(10), ' ') AS text FROM heard"""


def _pipeline_entities() -> str:
    return f"""ent AS (SELECT doc_id, label, word, instr(n.text, word) - 1 AS start, instr(n.text, word) - 1 + length(word) AS stop, n.text
  FROM {values(fixtures.PIPELINE_ENTITIES, 'doc_id, label, word')} JOIN n USING (doc_id))"""


def _resume_text() -> str:
    rows = values(fixtures.RESUMES, "id, language, job_title, technologies, certifications, name, email, university, degree, y, company, position, since, until")
    eng = lambda a, b: f"CASE WHEN language = 'English' THEN '{a}' ELSE '{b}' END"
    return f"""resume AS (SELECT id, concat_ws(chr(10), name, 'Email: ' || email, 'Phone: 000', 'Address: ' || id || ' Street', 'Postal Code: 000-0000', 'Date of Birth: 1990-01-01',
  {eng('PROFESSIONAL SUMMARY', '職務経歴書サマリー')},
  CASE WHEN language = 'English' THEN 'Experienced ' || job_title || ' with expertise in ' || array_to_string(technologies[1:3], ', ') || '.' ELSE job_title || 'として、' || array_to_string(technologies[1:3], ', ') || 'の知識を有する。' END,
  {eng('EDUCATION', '学歴')}, university || ' - ' || degree || ' (' || y || ')', {eng('WORK EXPERIENCE', '職務経歴')},
  company || ' - ' || position || ' (' || since || '-' || coalesce(until::VARCHAR, '現在') || ')', 'Work at ' || company || '.', {eng('TECHNICAL SKILLS', '技術スキル')}, array_to_string(technologies, ', '),
  {eng('CERTIFICATIONS', '資格')}, CASE WHEN len(certifications) > 0 THEN array_to_string(list_transform(certifications, lambda c: '• ' || c), chr(10)) END) AS text FROM {rows})"""


def all_queries() -> dict[str, str]:
    mask = quote("|".join([f"(?:{EMAIL})", *US_PHONES]))
    counts = " UNION ALL ".join(
        f"SELECT '{e}' AS entity, sum(len(regexp_extract_all(text, {quote(p)})))::BIGINT AS n FROM n" for e, p in {"EMAIL_ADDRESS": EMAIL, "PHONE_NUMBER": "|".join(US_PHONES)}.items()
    )
    spans, checked, resume_rows = document_spans(), verified(), "id, language, job_title, technologies, certifications, name, email, university, degree, y, company, position, since, until"
    resumes = values(fixtures.RESUMES, resume_rows)
    report = f"""{spans},
report AS (SELECT doc_id, chr(10) || repeat('=', 60) || chr(10) || 'Masking Log - {STAMP}' || chr(10) || repeat('=', 60) || chr(10)
  || string_agg({LOG_LINE}, chr(10) ORDER BY start) || chr(10) || 'Total: ' || count(*) || ' entities masked' AS report, list(entity) AS types FROM span GROUP BY doc_id)"""
    shapes = [
        (1, "r", "rule", "PHONE_NUMBER_JP", 0.9, rf"0{N}{{1,4}}-{N}{{1,4}}-{N}{{4}}", False), (2, "r", "rule", "JP_ZIP_CODE", 0.95, rf"{N}{{3}}-{N}{{4}}", False),
        (3, "r", "rule", "PHONE_NUMBER", 0.92, US_PHONES[1], False),
    ]
    # no context lifts here: the spans come from bare patterns
    bare = found(rules=shapes).replace("+ 0.35::DOUBLE", "+ 0.0::DOUBLE")
    required = [
        ("名前", ["PERSON", "JP_PERSON"]), ("Email", ["EMAIL_ADDRESS"]), ("住所", ["JP_ADDRESS", "ADDRESS", "LOCATION"]), ("生年月日", ["DATE_OF_BIRTH_JP", "DATE_OF_BIRTH", "DATE"]),
        ("郵便番号", ["JP_ZIP_CODE", "ZIP_CODE"]), ("電話番号", ["PHONE_NUMBER_JP", "PHONE_NUMBER"]),
    ]
    category = "CASE WHEN {e} IN ('LOCATION', 'JP_ADDRESS', 'LOC', 'GPE') THEN 'location' WHEN {e} IN ('PERSON', 'JP_PERSON', 'PER') THEN 'person' ELSE {e} END"
    flat = "SELECT doc_id, entity, text, start, \"end\", score, verified AS verified_score, source, section, status, reason FROM verdict WHERE status <> 'exclude'"
    active = 'SELECT doc_id, entity, start, "end", text, verified AS score, source FROM verdict WHERE status IN (\'mask\', \'review\')'
    return {name: plain_spans(*rule) for name, rule in SINGLE.items()} | {
        "normalized_text": corpus() + "\nSELECT doc_id, text, regexp_matches(coalesce(raw, ''), '[ぁ-んァ-ン一-龯]') AS japanese FROM n",
        "line_segments": segments() + "\nSELECT * FROM g",
        "section_summary": segments() + "\nSELECT doc_id, section_type, count(*) AS lines FROM g GROUP BY ALL",
        "contact_text": segments()
        + "\nSELECT n.doc_id, coalesce(string_agg(g.text, chr(10) ORDER BY line_number) FILTER (section_type = 'contact'), '') AS contact"
        + " FROM n LEFT JOIN g USING (doc_id) GROUP BY n.doc_id",
        "reconstructed_text": segments()
        + """, h AS (SELECT doc_id, line_number, text, start - coalesce(lag("end") OVER (PARTITION BY doc_id ORDER BY line_number), 0) AS gap FROM g)
SELECT n.doc_id, coalesce(string_agg(repeat(' ', gap) || h.text, '' ORDER BY line_number), '') AS text FROM n LEFT JOIN h USING (doc_id) GROUP BY n.doc_id""",
        "masked_documents": corpus()
        + f"\nSELECT doc_id, regexp_replace(text, {mask}, '****', 'g') AS masked, len(regexp_extract_all(text, {mask}))::BIGINT AS n_entities FROM n",
        "entity_stats": corpus() + f"\nSELECT entity, n FROM ({counts}) WHERE n > 0",
        "document_spans": f"{spans}\n{SPAN}",
        "confident_spans": f"{spans}\n{SPAN} WHERE score >= 0.8",
        "log_lines": f"{spans}\nSELECT doc_id, start::BIGINT AS start, {LOG_LINE} AS line FROM span",
        "masked_all_types": f"{spans},{masked()}\nSELECT * FROM masked",
        "entity_stats_all_types": f"{spans}\nSELECT entity, count(*) AS n FROM span GROUP BY entity",
        "entity_counts_by_document": f"{spans}\nSELECT doc_id, sum(count(*)) OVER (PARTITION BY doc_id)::BIGINT AS total, entity, count(*) AS n FROM span GROUP BY doc_id, entity",
        "detection_reports": f"{report}\nSELECT doc_id, report FROM report",
        "parsed_reports": f"{spans}\nSELECT doc_id, entity, t AS text, round(score, 2) AS score, start::BIGINT AS start, stop::BIGINT AS \"end\" FROM span",
        "missing_types": f"""{report},
required AS (SELECT *, row_number() OVER () AS place FROM {values(required, 'name, accepted')})
SELECT doc_id, coalesce(string_agg(name, ',' ORDER BY place) FILTER (NOT list_has_any(accepted, types)), '') AS missing FROM report, required GROUP BY doc_id""",
        "recognizer_audit": _audit(),
        "auto_language_spans": f"{_merged_languages()}\n{SPAN}",
        "routed_spans": document_spans(
            ["PHONE_NUMBER_JP", "JP_ZIP_CODE", "DATE_OF_BIRTH_JP", "JP_AGE", "JP_GENDER", "EMAIL_ADDRESS"], ((90, "staff", "transformer:staff", "CUSTOMER_ID_JP", 0.875, "EMP[0-9]{5}", False),)
        )
        + f"\n{SPAN}",
        "allow_terms": f"""
WITH l AS (SELECT position, trim(value) AS value FROM {values(list(enumerate(fixtures.DICTIONARY)), 'position, value')}),
p AS (SELECT position, trim(regexp_extract(value, '^(.*?)(?:/alias\\[|/js\\[|$)', 1)) AS main, string_split(regexp_extract(value, '/alias\\[([^\\]]*)\\]', 1), '|') AS aliases FROM l WHERE value <> ''),
t AS (SELECT position, 0 AS nth, main AS term FROM p UNION ALL SELECT position, generate_subscripts(aliases, 1), trim(unnest(aliases)) FROM p)
SELECT term, arg_min(position, position * 1000 + nth)::BIGINT AS position, arg_min(nth, position * 1000 + nth)::BIGINT AS nth FROM t WHERE term <> '' GROUP BY term""",
        "allowlist_excluded": f"{spans}\n{SPAN} WHERE lower(replace(replace(t, ' ', ''), '　', '')) NOT IN ('python', 'amazonwebservices', 'aws', 'amazonws', 'c++', 'postgresql', 'postgres', 'pg', 'help@example.com')",
        "section_located": f"""SELECT s.*, coalesce(section_id, 'unknown') AS section_id, coalesce(section_type, 'unknown') AS section_type
FROM ({plain_spans(*SINGLE['email_spans'])}) s LEFT JOIN ({segments()} SELECT * FROM g) g ON g.doc_id = s.doc_id AND g.start <= s.start AND s.start < g."end" """,
        "overlap_pairs": f"""{corpus()},{bare},
w AS (SELECT doc_id, entity, start, stop FROM scored)
SELECT a.doc_id, a.entity AS a_entity, a.start::BIGINT AS a_start, a.stop::BIGINT AS a_end, b.entity AS b_entity, b.start::BIGINT AS b_start, b.stop::BIGINT AS b_end,
  (least(a.stop, b.stop) - greatest(a.start, b.start))::BIGINT AS shared
FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.start < b.stop AND b.start < a.stop AND (a.start, a.stop, a.entity) < (b.start, b.stop, b.entity)""",
        "score_resolved_spans": f"{corpus()},{bare},{meaningful_and_greedy()}\nSELECT doc_id, entity, start::BIGINT AS start, stop::BIGINT AS \"end\", t AS text, score FROM span",
        "verified_candidates": f"{checked}\nSELECT * FROM verdict",
        "status_filtered": f"{checked}\n{active}",
        "flat_detections": f"{checked}\n{flat}",
        "masked_verified": f"""{checked},
m AS (SELECT doc_id, entity, start, "end" AS stop FROM verdict WHERE status = 'mask'),{masked('m')}
SELECT doc_id, masked FROM masked""",
        "dual_confirmed": f"""SELECT s.* FROM ({spans} {SPAN}) s WHERE EXISTS (SELECT 1 FROM ({checked} {active}) v WHERE v.doc_id = s.doc_id
  AND ({category.format(e='v.entity')}) = ({category.format(e='s.entity')}) AND least(v."end", s."end") > greatest(v.start, s.start)
  AND 2 * (least(v."end", s."end") - greatest(v.start, s.start)) >= least(v."end" - v.start, s."end" - s.start))""",
        "recall_by_document": f"""{spans},
e AS (SELECT * FROM {values(fixtures.EXPECTED, 'doc_id, text')})
SELECT doc_id::BIGINT AS doc_id, avg(CASE WHEN EXISTS (SELECT 1 FROM span s WHERE s.doc_id = e.doc_id AND trim(s.t) <> '' AND (contains(e.text, trim(s.t)) OR contains(trim(s.t), e.text))) THEN 1.0 ELSE 0.0 END)::DOUBLE AS recall,
  count(*) AS expected FROM e GROUP BY doc_id""",
        "ner_scored": f"""{corpus()}, {_pipeline_entities()},
w AS (SELECT *, substr(text, greatest(start - 50, 0) + 1, stop + 50 - greatest(start - 50, 0)) AS near FROM ent)
SELECT doc_id::BIGINT AS doc_id, CASE label WHEN 'PERSON' THEN 'JP_PERSON' ELSE 'JP_ADDRESS' END AS entity, start::BIGINT AS start, stop::BIGINT AS "end", word AS text,
  CASE WHEN regexp_matches(near, CASE label WHEN 'PERSON' THEN '氏名|ふりがな|フリガナ|名前|お名前|姓名' ELSE '住所|現住所|連絡先|都道府県|市区町村|番地|所在地' END) THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END AS score
FROM w WHERE label IN ('PERSON', 'LOC')""",
        "ner_candidates": verified(
            f"""UNION ALL SELECT e.doc_id, 1000000, coalesce(g.section_type, 'unknown'), 30, row_number() OVER (PARTITION BY e.doc_id ORDER BY label, word), 'ner:pipeline',
  CASE label WHEN 'PERSON' THEN 'JP_PERSON' WHEN 'ORG' THEN 'JP_ORGANIZATION' ELSE 'JP_ADDRESS' END, 0.7::DOUBLE, word, e.start::BIGINT, e.stop::BIGINT
  FROM (SELECT v.doc_id, label, word, instr(n.text, word) - 1 AS start, instr(n.text, word) - 1 + length(word) AS stop FROM {values(fixtures.PIPELINE_ENTITIES, 'doc_id, label, word')} v JOIN n USING (doc_id)) e
  LEFT JOIN g ON g.doc_id = e.doc_id AND g.start <= e.start AND e.start < g."end" """
        )
        + """
SELECT doc_id, entity, start, stop AS "end", t AS text, score, section_type FROM merged JOIN candidate USING (doc_id, r) WHERE source = 'ner:pipeline'""",
        "resume_sections": segments(f"{_resume_text()}, c AS (SELECT id AS doc_id, text FROM resume)") + "\nSELECT doc_id AS id, section_type, count(*) AS lines FROM g GROUP BY ALL",
        "decoded_labels": "SELECT id::BIGINT AS id, entity, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", text, score FROM (VALUES (1, 'PERSON', 0, 7, 'Ann Lee', 0.625::DOUBLE), (1, 'LOCATION', 11, 16, 'Paris', 0.5), (2, 'JP_PERSON', 0, 4, '山田太郎', 0.75), "
        "(2, 'JP_ADDRESS', 5, 8, '東京都', 0.25), (3, 'PERSON', 0, 1, 'B', 0.5), (3, 'PERSON', 2, 3, 'B', 0.75)) v(id, entity, start, \"end\", text, score)",
        "decoded_words": "SELECT id::BIGINT AS id, entity, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", text, score FROM (VALUES (1, 'PERSON', 0, 7, 'Ann Lee', 0.75::DOUBLE), (1, 'PERSON', 0, 3, 'Ann', 0.5), (1, 'LOCATION', 23, 28, 'Paris', 0.5), (2, 'JP_PERSON', 0, 4, '山田太郎', 0.5)) "
        "v(id, entity, start, \"end\", text, score)",
        "recovered_spans": "SELECT id::BIGINT AS id, entity, start::BIGINT AS start, \"end\"::BIGINT AS \"end\", text, score FROM (VALUES (1, 'JP_PERSON', 7, 11, '山田太郎', 0.85::DOUBLE), (1, 'CUSTOMER_ID_JP', 20, 28, 'ABC12345', 0.85), (1, 'JP_ADDRESS', 31, 37, '東京都練馬区', 0.85), "
        "(3, 'JP_PERSON', 3, 5, '鈴木', round(0.85 * 2 * 14 / 30, 6)), (5, 'JP_PERSON', 6, 14, ' x@y.co ', 0.85)) v(id, entity, start, \"end\", text, score)",
        "discarded_tags": "SELECT id::BIGINT AS id, tag, reason FROM (VALUES (2, '<customer-id>', 'no_right_anchor'), (4, '<name>', 'span_too_long(len=50, max=40)')) v(id, tag, reason)",
        "generation_codec": corpus()
        + "\nSELECT doc_id, replace(coalesce(raw, ''), chr(10), '<LB>') AS encoded, translate(coalesce(raw, ''), '：；？！（）［］｛｝　', ':;?!()[]{} ') AS narrow FROM n",
        "docx_text": corpus() + "\nSELECT doc_id, coalesce(text, '') AS text, NULL::VARCHAR AS error FROM c",
        "resume_titles": f"SELECT job_title, count(*) AS n FROM {resumes} GROUP BY job_title",
        "resume_technologies": f"""WITH t AS (SELECT id, unnest(technologies) AS technology, generate_subscripts(technologies, 1) AS place FROM {resumes})
SELECT technology, count(*) AS n FROM t GROUP BY technology ORDER BY n DESC, min(id || lpad(place::VARCHAR, 5, '0')) LIMIT 10""",
        "resume_emails": f"SELECT id, job_title, email FROM {resumes} WHERE language = 'Japanese'",
        "resume_text": f"WITH {_resume_text()} SELECT id, text FROM resume",
    }
