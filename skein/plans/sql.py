"""DuckDB expressions of the text rules, for the oracles."""

from __future__ import annotations

from skein.functions import lexicon as L


def quote(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '\\s+', ' ', 'g'))"


def norm(x: str) -> str:
    bare = f"regexp_replace(strip_accents(coalesce({x}, '')), '[\\x{{0300}}-\\x{{036f}}]', '', 'g')"
    kept = f"regexp_replace(regexp_replace(lower({bare}), '[’''`]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\s]', ' ', 'g')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


def tokens(x: str) -> str:
    return f"[t FOR t IN string_split({norm(x)}, ' ') IF t <> '']"


def content(x: str) -> str:
    return f"[t FOR t IN string_split({norm(x)}, ' ') IF t <> '' AND t NOT IN ({quote(L.STOP_WORDS)})]"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def containment(a: str, b: str) -> str:
    least = f"least(len(list_distinct({a})), len(list_distinct({b})))"
    return f"CASE WHEN {least} = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / {least} END"


def similar(a: str, b: str, threshold: float = 0.75) -> str:
    return f"(({jaccard(a, b)}) >= {threshold} OR (least(len({a}), len({b})) >= 3 AND ({containment(a, b)}) >= 0.95))"


def hash53(x: str) -> str:
    lane = lambda seed, k: f"list_reduce(list_prepend({seed}::UBIGINT, [unicode(c)::UBIGINT FOR c IN string_split({x}, '') IF c <> '']), lambda v, c: (xor(v, c) * {k}::UBIGINT) & 4294967295::UBIGINT)"
    stir = lambda a, b: f"xor((xor({a}, {a} >> 16) * 2246822507::UBIGINT) & 4294967295::UBIGINT, (xor({b}, {b} >> 13) * 3266489909::UBIGINT) & 4294967295::UBIGINT)"
    one, two = lane(3735928559, 2654435761), lane(1103547991, 1597334677)
    low = stir(f"({one})", f"({two})")
    return f"lower(to_base((({stir(f'({two})', f'({low})')}) & 2097151::UBIGINT)::BIGINT * 4294967296 + ({low})::BIGINT, 36))"


def grams(x: str) -> str:
    """The letter pairs of a normal form, as a list."""
    return f"[substr(' ' || {x} || ' ', i, 2) FOR i IN range(1, length({x}) + 2)]"


def slug(x: str) -> str:
    return f"coalesce(nullif(left(replace({norm(x)}, ' ', '-'), 48), ''), 'x')"


def has_words(x: str, words: list[str]) -> str:
    pattern = ("(?i)\\b" + L.whole_words(words) + "\\b").replace("'", "''")
    return f"regexp_matches(coalesce({x}, ''), '{pattern}')"


def cut(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN regexp_replace(left({x}, {most}), '\\s+\\S*$', '') ELSE {x} END"


def sanitize(x: str, most: int = 200) -> str:
    bare = f"regexp_replace(regexp_replace(coalesce({x}, ''), '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g'), '<[^>]*>', '', 'g')"
    return cut(collapse(f"replace(replace({bare}, '{{{{', '{{ {{'), '}}}}', '}} }}')"), most)


def sanitize_key(x: str) -> str:
    flat = f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '\\{{\\{{.*?\\}}\\}}', '', 'g'), '[\\r\\n]+', ' ', 'g'))"
    edge = "[/\"''“”‘’\\s]+"
    bare = f"regexp_replace({flat}, '^{edge}|{edge}$', '', 'g')"
    return f"CASE WHEN length({bare}) BETWEEN 2 AND 40 AND {norm(bare)} NOT IN ({quote(L.GENERIC_WORDS)}) AND NOT regexp_matches({bare}, '^[0-9\\W]+$') THEN {bare} END"


def family(x: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.FAMILIES.items()) + " ELSE 'other' END"


def guard(x: str, status: str) -> str:
    return f"CASE WHEN {status} <> 'confirmed' THEN {status} WHEN {has_words(x, L.FUTURE)} THEN 'plan' WHEN {has_words(x, L.CLAIM)} THEN 'claim' WHEN {has_words(x, L.HEDGE)} THEN 'unresolved' ELSE 'confirmed' END"


#: Messages and their chain; use after WITH.
CHAIN = f"""
msgs AS (SELECT conv_id::VARCHAR AS chat_id, turn AS idx, role, {collapse("text")} AS text FROM conversations),
chain AS (
  SELECT chat_id, idx, row_number() OVER (PARTITION BY chat_id ORDER BY idx) - 1 AS pos,
         md5((CASE WHEN role = 'user' THEN 'u|' ELSE 'a|' END) || text) AS sig, role = 'user' AS is_user,
         CASE WHEN role = 'user' THEN 'User' ELSE 'Narrator' END AS name, text
  FROM msgs WHERE role <> 'system' AND text <> ''
)"""

#: Events as observations: user = chat, event_type = entity, place = order by time.
OBSERVED = """
obs AS (
  SELECT user_id::VARCHAR AS chat_id, event_type AS entity_id, event_id AS obs_id, value,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
         least(10.0, value / 20) AS importance, least(1.0, value / 60) AS confidence
  FROM events
)"""


def ledger(gap: int = 6) -> str:
    """The ledger over events and its view; use after WITH. "at" is where a message that is still there stands in its chat."""
    from skein.functions.settings import Settings
    from skein.plans.inputs import TYPE_OF

    kinds = "CASE name " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPE_OF.items()) + " END"
    rules = ", ".join(f"('{t}', {r.on}, {r.min_appearances}, {float(r.min_importance)})" for t, r in Settings().type_rules.items())
    return f"""{OBSERVED},
live AS (SELECT * REPLACE (CASE WHEN entity_id = 'view' AND chat_id::BIGINT % 11 = 0 THEN 'click' ELSE entity_id END AS entity_id), entity_id AS name, row_number() OVER (PARTITION BY chat_id ORDER BY pos) - 1 AS "at" FROM obs WHERE value >= 1),
typed AS (SELECT *, {kinds} AS kind FROM live),
named AS (SELECT chat_id, entity_id, name FROM (SELECT chat_id, entity_id, name, row_number() OVER (PARTITION BY chat_id, entity_id ORDER BY count(*) DESC, min("at")) AS r FROM live GROUP BY chat_id, entity_id, name) WHERE r = 1),
kinds AS (SELECT chat_id, entity_id, kind FROM (SELECT chat_id, entity_id, kind, row_number() OVER (PARTITION BY chat_id, entity_id ORDER BY count(*) DESC, min("at")) AS r FROM typed WHERE kind <> 'other' GROUP BY chat_id, entity_id, kind) WHERE r = 1),
roll AS (SELECT chat_id, entity_id, count(*) AS live_obs, min("at") AS first_at, max("at") AS last_at, max(importance) AS imp_max, avg(importance) AS imp_avg, max(confidence) AS conf_max FROM live GROUP BY ALL),
epi AS (SELECT chat_id, entity_id, count(*) AS appear, sum(CASE WHEN before IS NULL OR "at" - before > {gap} THEN 1 ELSE 0 END) AS episodes
  FROM (SELECT *, lag("at") OVER (PARTITION BY chat_id, entity_id ORDER BY "at") AS before FROM live) GROUP BY ALL),
said AS (SELECT chat_id, entity_id, 'w' || md5(name) || ' seen' AS text, CASE WHEN value < 50 THEN 'rumor' ELSE 'confirmed' END AS status, min("at") AS "at", count(*) AS n FROM live GROUP BY ALL),
facts AS (SELECT s.*, CASE WHEN s.status = 'rumor' AND c."at" > s."at" THEN 'superseded' WHEN s.entity_id = 'purchase' THEN 'in-static' ELSE 'active' END AS state
  FROM said s LEFT JOIN said c ON c.chat_id = s.chat_id AND c.entity_id = s.entity_id AND c.text = s.text AND c.status = 'confirmed' AND s.status = 'rumor'),
content AS (SELECT chat_id, entity_id, bool_or(state = 'active') AS has_content FROM facts GROUP BY ALL),
rules(type, is_on, times, least) AS (VALUES {rules}),
ents AS (SELECT *, coalesce(kind, 'other') AS type, entity_id = 'purchase' AS static,
    CASE WHEN entity_id = 'click' AND chat_id::BIGINT % 7 = 0 THEN 'promote' WHEN entity_id = 'error' AND chat_id::BIGINT % 5 = 0 THEN 'reject' END AS user_status
  FROM roll JOIN epi USING (chat_id, entity_id) JOIN named USING (chat_id, entity_id) LEFT JOIN kinds USING (chat_id, entity_id) JOIN content USING (chat_id, entity_id)),
view AS (
  SELECT ents.*, CASE WHEN user_status = 'reject' THEN 'rejected' WHEN user_status = 'promote' AND has_content THEN 'promoted' WHEN user_status = 'promote' THEN 'candidate'
    WHEN NOT is_on THEN 'excluded' WHEN conf_max < 0.6 THEN 'candidate' WHEN imp_max < greatest(3, least) AND imp_max < 8 THEN 'candidate'
    WHEN imp_max < 8 AND episodes < times AND appear < 10 THEN 'candidate' WHEN NOT has_content THEN 'candidate' ELSE 'promoted' END AS state,
  CASE WHEN user_status = 'reject' THEN 'rejected by user' WHEN user_status = 'promote' AND has_content THEN 'promoted by user' WHEN user_status = 'promote' THEN 'promoted by user but no facts yet'
    WHEN NOT is_on THEN 'type "' || type || '" is excluded' WHEN conf_max < 0.6 THEN 'confidence # < 0.6'
    WHEN imp_max < greatest(3, least) AND imp_max < 8 THEN 'importance # < ' || greatest(3, least)::INT
    WHEN imp_max < 8 AND episodes < times AND appear < 10 THEN 'seen in ' || episodes::INT || ' scene(s); needs ' || times || ' or importance ≥ 8'
    WHEN NOT has_content AND static THEN 'nothing new beyond static lore' WHEN NOT has_content THEN 'no established facts yet'
    WHEN imp_max >= 8 THEN 'importance # ≥ 8' ELSE episodes::INT || ' scenes, importance #' END AS reason
  FROM ents JOIN rules USING (type)),
cards AS (
  SELECT chat_id, entity_id, name, type, name || ' (' || type || ')' || coalesce(': ' || (SELECT string_agg(text, '. ' ORDER BY "at") FROM facts f WHERE f.chat_id = v.chat_id AND f.entity_id = v.entity_id AND f.state = 'active' AND status = 'confirmed'), '') || '.'
    || coalesce(chr(10) || 'Rumors (unverified): ' || (SELECT string_agg(text, '; ' ORDER BY "at") FROM facts f WHERE f.chat_id = v.chat_id AND f.entity_id = v.entity_id AND f.state = 'active' AND status = 'rumor') || '.', '') AS content
  FROM view v WHERE state = 'promoted')"""
