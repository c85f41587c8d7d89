"""Building blocks of the DuckDB check queries.

Each function returns the text of one CTE.  The checks share nothing with the
Spark operators but the fixed values: lookarounds become run-length counts and
every list step uses DuckDB's own list functions.
"""

from __future__ import annotations

from ..functions import fixed as K
from ..sources import synthesize as S, templates as T


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def text_list(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]"


def hexnum(digest: str, start: int = 1, digits: int = 8) -> str:
    return f"('0x' || substr({digest}, {start}, {digits}))::BIGINT"


def md5(*parts: str) -> str:
    return "md5(" + " || '|' || ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"


def uniform(digest: str) -> str:
    return f"(({hexnum(digest, 1, 13)})::DOUBLE + 0.5) / {float(2**52)!r}"


def half_even(x: str, places: int) -> str:
    return f"round_even({x}, {places})"


def scripts(table: str = "orders", key: str = "o_orderkey", seed: int = 1337,
            prefix: str = "", name: str = "scripts") -> str:
    """CTEs that rebuild the generated corpus from ``table``."""
    n = max(S.slot_position(s)[0] for s in S.SLOTS) + 1
    digests = ", ".join(f"{md5(lit(str(seed)), key, str(i))} AS d{i}" for i in range(n))

    def draw(slot: str) -> str:
        d, start = S.slot_position(slot)
        return hexnum(f"d{d}", start)

    upper, arms = 0, []
    for cat, share in T.CATEGORY_SHARES:
        upper += share
        arms.append(f"WHEN {draw('category')} % {S.SHARE_TOTAL} < {upper} THEN {lit(cat)}")
    sizes = " ".join(f"WHEN {lit(c)} THEN {k}" for c, k in S.template_counts().items())
    rows = ",\n".join(
        f"({lit(c)}, {p}, {lit(t)}, {lab}, {lit(why)}, {lit(body)})"
        for c, p, t, lab, why, body in S.template_rows())
    text = (f"replace(body, '{{pad}}', repeat({lit(T.PAD_LINE)}, "
            f"({draw('pad')} % {T.PAD_MAX})::INTEGER))")
    for pool, values in T.POOLS.items():
        choice = f"{text_list(values)}[({draw(pool)} % {len(values)})::INTEGER + 1]"
        text = f"replace({text}, '{{{pool}}}', {choice})"
    text = f"replace({text}, '{{n}}', CAST(key AS VARCHAR))"
    return f"""{name}_draw AS (
  SELECT {key} AS key, {digests} FROM {table}
), {name}_cat AS (
  SELECT *, CASE {' '.join(arms)} END AS category FROM {name}_draw
), {name}_tpl(category, position, template, label, rationale, body) AS (
  VALUES {rows}
), {name} AS (
  SELECT id, category, label, CASE WHEN label = 1 THEN 'dangerous' ELSE 'safe' END AS label_name,
         rationale, template, 'scripts/' || id || '.sh' AS path,
         'generated/seed={seed}' AS provenance, script, length(script)::INTEGER AS n_chars,
         (length(script) - length(replace(script, chr(10), '')))::INTEGER AS n_lines
  FROM (
    SELECT {lit(prefix)} || c.category || '_' || lpad(CAST(key AS VARCHAR), 10, '0') AS id,
           c.category, label::INTEGER AS label, rationale, template, {text} AS script
    FROM {name}_cat c JOIN {name}_tpl t
      ON t.category = c.category
     AND t.position = {draw('template')} % (CASE c.category {sizes} END)
  )
)"""


# --------------------------------------------------------------------------- #
# Lexical facts                                                               #
# --------------------------------------------------------------------------- #
WHITE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_BALANCED = r"""^((?:[^'"\\#]|\\[\s\S]|'[^']*'|"(?:[^"\\]|\\[\s\S])*")*)(?:#[\s\S]*)?$"""
_WORD = r"""(?:[^ \t\r\n'"\\]|\\[\s\S]|'[^']*'|"(?:[^"\\]|\\[\s\S])*")+"""
_PIECE = r"""[^'"\\]+|\\[\s\S]|'[^']*'|"(?:[^"\\]|\\[\s\S])*\""""


def count(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, {lit(pattern)}))"


def found(text: str, pattern: str, flags: str = "") -> str:
    return f"regexp_matches({text}, {lit(flags + pattern)})"


def first_seen(items: str) -> str:
    """Distinct list elements in first-seen order."""
    return f"list_filter({items}, lambda x, i: list_position({items}, x) = i)"


def strip(x: str) -> str:
    return f"trim({x}, {WHITE})"


def basename(x: str) -> str:
    return f"""split_part(trim({strip(x)}, '"' || chr(39)), '/', -1)"""


def urls(t: str) -> str:
    return f"regexp_extract_all({t}, {lit('(?i)' + K.URL_PATTERN)})"


def paths(t: str) -> str:
    pattern = r"(?:^|[^\w-])" + K.PATH_BODY
    return (f"list_filter(regexp_extract_all({t}, {lit(pattern)}, 1), "
            f"lambda p: NOT starts_with(p, '/dev/'))")


def devices(t: str) -> str:
    return f"regexp_extract_all({t}, {lit(K.DEVICE_PATTERN)})"


def line_count(t: str) -> str:
    return (f"(CASE WHEN {t} = '' THEN 0 ELSE {count(t, chr(13) + chr(10) + '|[' + chr(13) + chr(10) + chr(11) + chr(12) + ']')} "
            f"+ (CASE WHEN {found(t, '[' + chr(13) + chr(10) + chr(11) + chr(12) + ']$')} THEN 0 ELSE 1 END) END)::INTEGER")


def comment_lines(t: str) -> str:
    return (f"({count(t, '(?:^|' + chr(10) + r')\s*#')} - "
            f"{count(t, '(?:^|' + chr(10) + r')\s*#!')})::INTEGER")


def pipe_count(t: str) -> str:
    return rf"len(list_filter(regexp_extract_all({t}, '\|+'), lambda r: length(r) = 1))::INTEGER"


def substitutions(t: str) -> str:
    return f"({count(t, K.SUBSTITUTION_PATTERN)})::INTEGER"


def redirections(t: str) -> str:
    """Runs of ``>``: a digit in front disarms the first sign; each pair counts once."""
    gt = (f"coalesce(list_sum(list_transform(regexp_extract_all({t}, '[0-9]?>+'), "
          f"lambda r: CASE WHEN regexp_matches(r, '^[0-9]') THEN (length(r) - 1) // 2 "
          f"ELSE (length(r) + 1) // 2 END)), 0)")
    lt = (f"coalesce(list_sum(list_transform(regexp_extract_all({t}, '<+'), "
          f"lambda r: (length(r) + 1) // 2)), 0)")
    return f"({gt} + {lt})::INTEGER"


def background_jobs(t: str) -> str:
    return f"({count(t, '&+')})::INTEGER"


def heredocs(t: str) -> str:
    return f"({count(t, K.HEREDOC_PATTERN)})::INTEGER"


def pipes_to_shell(t: str) -> str:
    word = r"regexp_extract(" + strip("s") + r", '^(sudo\s+)?(\S+)', 2)"
    return (f"len(list_filter(string_split({t}, '|')[2:], lambda s: "
            f"list_contains({text_list(K.SHELL_INTERPRETERS)}, {basename(word)}))) > 0")


def segments(t: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({t}, {lit(K.SEGMENT_PATTERN)}), "
            f"lambda s: {strip('s')}), lambda s: s <> '' AND NOT starts_with(s, '#'))")


def seg_words(segs: str) -> str:
    inner = "p[2:length(p) - 1]"
    piece = (f"CASE WHEN starts_with(p, chr(39)) THEN {inner} "
             f"""WHEN starts_with(p, '"') THEN regexp_replace({inner}, '\\\\(["\\\\])', '\\1', 'g') """
             f"WHEN starts_with(p, chr(92)) THEN p[2:2] ELSE p END")
    unquoted = (f"CASE WHEN regexp_matches(w, {lit(chr(91) + chr(39) + chr(34) + chr(92) * 2 + chr(93))}) "
                f"THEN array_to_string(list_transform(regexp_extract_all(w, {lit(_PIECE)}), lambda p: {piece}), '') "
                f"ELSE w END")
    words = (f"list_transform(regexp_extract_all(regexp_extract(s, {lit(_BALANCED)}, 1), {lit(_WORD)}), "
             f"lambda w: {unquoted})")
    loose = r"list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')"
    return (f"list_transform({segs}, lambda s: CASE WHEN regexp_matches(s, {lit(_BALANCED)}) "
            f"THEN {words} ELSE {loose} END)")


def commands_raw(words: str) -> str:
    """Command names with repeats, in script order."""
    first = (f"list_filter(t, lambda x: NOT regexp_matches(x, {lit(K.ASSIGNMENT_PATTERN)}) "
             f"AND NOT list_contains({text_list(K.SKIPPED_WORDS)}, x))[1]")
    return (f"list_transform(list_filter(list_transform({words}, lambda t: {first}), "
            f"lambda c: c IS NOT NULL AND c <> '' AND NOT starts_with(c, '-')), "
            f"lambda c: {basename('c')})")


def flags_raw(words: str) -> str:
    return f"list_filter(flatten({words}), lambda x: starts_with(x, '-') AND length(x) > 1)"


def parsed(src: str = "scripts", name: str = "parsed", text: str = "script") -> str:
    t = text
    return f"""{name}_seg AS (SELECT *, {segments(t)} AS segs FROM {src}
), {name}_words AS (SELECT *, {seg_words('segs')} AS sw FROM {name}_seg
), {name}_raw AS (
  SELECT *, {commands_raw('sw')} AS cmd_raw, {flags_raw('sw')} AS flag_raw, {paths(t)} AS path_raw,
    {urls(t)} AS url_raw, {devices(t)} AS dev_raw FROM {name}_words
), {name} AS (
  SELECT * EXCLUDE (segs, cmd_raw, flag_raw, path_raw, url_raw, dev_raw),
    {first_seen('cmd_raw')} AS commands, {first_seen('flag_raw')} AS flags, flatten(sw) AS words,
    {first_seen('path_raw')} AS paths, {first_seen('url_raw')} AS urls,
    {first_seen('dev_raw')} AS devices,
    {pipe_count(t)} AS pipe_count, {pipes_to_shell(t)} AS pipes_to_shell,
    {substitutions(t)} AS command_substitutions, {redirections(t)} AS redirections,
    {background_jobs(t)} AS background_jobs, {heredocs(t)} AS heredocs,
    {line_count(t)} AS line_count, {comment_lines(t)} AS comment_lines
  FROM {name}_raw
)"""


# --------------------------------------------------------------------------- #
# Context, signatures, features, score                                        #
# --------------------------------------------------------------------------- #
def has_any(items: str, names) -> str:
    return f"list_has_any({items}, {text_list(names)})"


def _capped(*evidence) -> str:
    parts = " + ".join(f"(CASE WHEN {c} THEN {w!r}::DOUBLE ELSE 0.0::DOUBLE END)" for c, w in evidence)
    return f"least(1.0::DOUBLE, 0.0::DOUBLE + {parts})"


def context(src: str = "parsed", name: str = "ctx", text: str = "script") -> str:
    t = text
    sensitive = "^(" + "|".join(K.SENSITIVE_ROOTS) + ")"
    dims = {
        "privilege_required": _capped((has_any("commands", K.PRIVILEGED_COMMANDS), 0.7),
                                      (found(t, K.PRIVILEGE_PATTERN), 0.3)),
        "network_egress": _capped((has_any("commands", K.NETWORK_COMMANDS), 0.5),
                                  ("len(urls) > 0", 0.3), ("pipes_to_shell", 0.2),
                                  (found(t, K.DEV_NET_PATTERN), 0.4)),
        "filesystem_scope": _capped(
            (f"len(list_filter(list_concat(paths, devices), lambda p: {found('p', sensitive)})) > 0", 0.5),
            ("len(devices) > 0", 0.3),
            (f"{found(t, K.RECURSIVE_FLAG_PATTERN)} AND len(paths) > 0", 0.2),
            (found(t, K.BROAD_TARGET_PATTERN), 0.3)),
        "irreversibility": _capped((has_any("commands", K.DESTRUCTIVE_COMMANDS), 0.5),
                                   (found(t, K.RM_FLAG_PATTERN), 0.2),
                                   (found(t, K.DEVICE_WRITE_PATTERN), 0.3),
                                   (found(t, K.SHRED_PATTERN), 0.2)),
        "obfuscation": _capped(
            (found(t, K.BASE64_PATTERN), 0.35), (found(t, K.EVAL_PATTERN), 0.25),
            (found(t, K.HEX_RUN_PATTERN), 0.25), (found(t, K.PRINTF_OCTAL_PATTERN), 0.2),
            (found(t, K.REVERSE_PATTERN), 0.1),
            (f"line_count > 0 AND command_substitutions::DOUBLE / greatest(1, line_count) > "
             f"{K.SUBSTITUTIONS_PER_LINE}", 0.15)),
    }
    cols = ",\n    ".join(f"{sql} AS context_{d}" for d, sql in dims.items())
    return f"{name} AS MATERIALIZED (\n  SELECT *, {cols}\n  FROM {src}\n)"


def flags_cte(src: str, name: str = "flagged", text: str = "script") -> str:
    cols = ",\n    ".join(f"{found(text, s[3], '(?m)')} AS sig_{s[0]}" for s in K.SIGNATURES)
    return f"{name} AS MATERIALIZED (\n  SELECT *, {cols}\n  FROM {src}\n)"


def cat_sum(category: str) -> str:
    terms = [f"(CASE WHEN sig_{s[0]} THEN {s[2]!r}::DOUBLE ELSE 0.0::DOUBLE END)"
             for s in K.SIGNATURES if s[1] == category]
    return "(0.0::DOUBLE + " + " + ".join(terms) + ")"


def hit_list() -> str:
    items = ", ".join(f"CASE WHEN sig_{s[0]} THEN {lit(s[0])} END" for s in K.SIGNATURES)
    return f"list_filter([{items}], lambda h: h IS NOT NULL)"


def features(src: str = "flagged", name: str = "features") -> str:
    cats = [c for c in K.SIGNATURE_CATEGORIES]
    sums = ", ".join(f"{cat_sum(c)} AS cat_{c}" for c in cats)
    total = "(0.0::DOUBLE + " + " + ".join(f"cat_{c}" for c in cats) + ")"
    top = "greatest(0.0::DOUBLE, " + ", ".join(f"cat_{c}" for c in cats) + ")"
    npos = "(" + " + ".join(f"(CASE WHEN cat_{c} > 0 THEN 1 ELSE 0 END)" for c in cats) + ")"

    def binary(cond: str) -> str:
        return f"(CASE WHEN {cond} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"

    return f"""{name}_sums AS (SELECT *, {sums}, {hit_list()} AS hit_ids FROM {src}
), {name} AS MATERIALIZED (
  SELECT *,
    {binary('pipes_to_shell')} AS semantic_pipes_to_shell,
    {binary(has_any('commands', K.SCORING_DESTRUCTIVE))} AS semantic_has_destructive_cmd,
    {binary(has_any('commands', K.SCORING_NETWORK))} AS semantic_has_network_cmd,
    {binary('len(devices) > 0')} AS semantic_has_device_target,
    least(1.0::DOUBLE, CASE WHEN line_count > 0
      THEN command_substitutions::DOUBLE / line_count ELSE 0.0::DOUBLE END)
      AS semantic_cmd_substitution_density,
    least(1.0::DOUBLE, greatest(0.0::DOUBLE, {total}) / {K.SIGNATURE_WEIGHT_SCALE!r}::DOUBLE)
      AS threat_weight_norm,
    least(1.0::DOUBLE, {top} / {K.CATEGORY_WEIGHT_SCALE!r}::DOUBLE) AS threat_max_category_norm,
    {npos} / {K.CATEGORY_COUNT_SCALE!r}::DOUBLE AS threat_distinct_categories
  FROM {name}_sums
)"""


def level_case(risk: str) -> str:
    arms = " ".join(f"WHEN {risk} < {b!r} THEN {lit(l)}" for b, l in K.LEVEL_BOUNDS)
    return f"(CASE {arms} ELSE {lit(K.TOP_LEVEL)} END)"


def logit(disabled=(), weights=K.DEFAULT_WEIGHTS, bias=K.DEFAULT_BIAS) -> str:
    off = {f for g in disabled for f in K.FEATURE_GROUPS[g]}
    terms = "".join(f" + {float(weights[f])!r}::DOUBLE * {f}" for f in K.FEATURES if f not in off)
    return f"({bias!r}::DOUBLE{terms})"


def sigmoid(z: str) -> str:
    return f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({z}))))"


def scored(src: str = "features", name: str = "scored", disabled=(),
           threshold: float = K.DEFAULT_THRESHOLD) -> str:
    return f"""{name} AS MATERIALIZED (
  SELECT *, 1.0::DOUBLE - risk AS trust, {level_case('risk')} AS level,
    risk >= {threshold!r} AS dangerous
  FROM (SELECT *, {sigmoid('logit')} AS risk FROM (SELECT *, {logit(disabled)} AS logit FROM {src}))
)"""


def corpus_scored(table: str = "orders", key: str = "o_orderkey", seed: int = 1337,
                  prefix: str = "", tag: str = "") -> str:
    """The whole chain from a key table to a CTE ``scored<tag>``."""
    return ",\n".join([
        scripts(table, key, seed, prefix, f"scripts{tag}"),
        parsed(f"scripts{tag}", f"parsed{tag}"),
        context(f"parsed{tag}", f"ctx{tag}"),
        flags_cte(f"ctx{tag}", f"flagged{tag}"),
        features(f"flagged{tag}", f"features{tag}"),
        scored(f"features{tag}", f"scored{tag}"),
    ])


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
