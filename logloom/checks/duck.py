"""DuckDB SQL text for the oracle side of the correctness gate.

These builders write the same semantics as :mod:`logloom.functions` in DuckDB
SQL (RE2 regexes, ``lambda`` list functions) so that every registered Spark
query has an independent SQL statement over the same parquet views. RE2 has
ASCII ``\\s \\w \\d``; the classes below spell out the Unicode sets that Java's
``(?U)`` flag uses.
"""

from __future__ import annotations

# Fixed values that must equal the reference, stated here anew: a wrong pattern in
# logloom.functions must not pass by being on both sides.
MESSAGE_REWRITES = [("logname uid", "logname null uid"), ("ruser rhost", "ruser null rhost"),
                    ("invalid user from", "invalid_user from")]
MASK_PATTERNS = [
    r"/\S+",
    r"\w+@\S+",
    r"(\w\+|\w-)",
    r"(\w{2}:){5}\w{2}",
    r"\S*\d\S*",
    r"\S+\.(com|net|\w{2})",
    r"(Mon|Tue|Wed|Thu|Fri|Sat|Sun)",
    r"(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
]
TEMPLATE_RULES = [
    (r"\d+:\d+", "{time}"),
    (r"(0x|0)[a-fA-F0-9]+", "{hex_code}"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "{ip_address}"),
    (r"([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}", "{mac_address}"),
    (r"\S+@\S+", "{email}"),
    (r"(=|==)\S+", "{unknown}"),
]
SCORING_PUNCT = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
SCORING_KEEP = "=|()"

WS = r"[\t\n\x0B\f\r\x{85}\p{Z}]"
NWS = r"[^\t\n\x0B\f\r\x{85}\p{Z}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]"
NWORD = r"[^\p{L}\p{M}\p{Nd}\p{Pc}]"
DIGIT = r"\p{Nd}"
PUNCT_CLASS = r"[!-/:-@\[-`{-~]"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """Rewrite a Java ``(?U)`` pattern (no classes containing shorthands) for RE2."""
    out, i = [], 0
    table = {"s": WS, "S": NWS, "w": WORD, "W": NWORD, "d": DIGIT}
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            nxt = pattern[i + 1]
            out.append(table.get(nxt, "\\" + nxt))
            i += 2
        else:
            out.append(ch)
            i += 1
    return "".join(out)


def rx(expr: str, pattern: str, repl: str) -> str:
    return f"regexp_replace({expr}, {q(pattern)}, {q(repl)}, 'g')"


def remove_punctuation(e: str) -> str:
    return rx(e, PUNCT_CLASS, "")


def correct_message(e: str) -> str:
    for old, new in MESSAGE_REWRITES:
        e = f"replace({e}, {q(old)}, {q(new)})"
    e = rx(e, r"\.{3,}", " ")
    e = rx(e, WS + "+", " ")
    return f"trim({e}, '. ')"


def mask_chain(e: str) -> str:
    """F2 up to (not including) the adjacent-duplicate collapse; single-spaced."""
    for p in MASK_PATTERNS:
        e = rx(e, re2(p), "{Var}")
    e = f"replace({e}, '{{Var}} ', '{{Var}}')"
    e = rx(e, r"(\{Var\})+", "{Var}")
    e = remove_punctuation(e)
    return rx(e, WS + "+", " ")


def dedup_adjacent(list_col: str) -> str:
    """Drop list elements equal to their predecessor (``list_col`` must be a column)."""
    return f"list_filter({list_col}, lambda x_, i_: i_ = 1 OR x_ <> {list_col}[i_ - 1])"


def words(e: str) -> str:
    return f"list_filter(regexp_split_to_array({e}, {q(WS + '+')}), lambda x_: x_ <> '')"


def star_numbers(e: str) -> str:
    return rx(e, DIGIT + r"+(\." + DIGIT + "+)?", "*")


def tokens(e: str) -> str:
    """F4 over an expression (the expression may be repeated in the output)."""
    neq = "(length(w_) - length(replace(w_, '=', '')))"
    mapped = (f"list_transform(regexp_split_to_array({e}, '[ ,|{{}}]'), lambda w_: CASE "
              f"WHEN {neq} = 1 THEN split_part(w_, '=', 1) "
              f"WHEN {neq} >= 2 THEN NULL WHEN contains(w_, '/') THEN NULL "
              f"ELSE {star_numbers('w_')} END)")
    kept = f"list_filter({mapped}, lambda w_: w_ IS NOT NULL AND w_ <> '')"
    return f"(CASE WHEN len({kept}) = 0 THEN [{star_numbers(e)}] ELSE {kept} END)"


def rule_chain(e: str) -> str:
    for p, repl in TEMPLATE_RULES:
        e = rx(e, re2(p), repl)
    return e


def rule_tokens(ws_col: str) -> str:
    """F8 token pass over a materialised word list column ``ws_col``."""
    return (f"array_to_string(list_transform({ws_col}, lambda t_, i_: CASE "
            f"WHEN i_ > 1 AND {ws_col}[i_ - 1] IN ('=', '==') THEN '{{unknown}}' "
            f"WHEN regexp_matches(t_, {q('^' + NWORD + '*' + DIGIT)}) THEN '{{number}}' "
            f"WHEN regexp_matches(t_, {q('^' + NWORD + '*(file:|folder:)*/+' + NWS)}) THEN '{{file_path}}' "
            f"ELSE t_ END), ' ')")


def canonical_template(e: str) -> str:
    """F9 over an expression."""
    mapped = (f"list_transform({words(e)}, lambda t_: CASE WHEN regexp_matches(t_, {q(r'\{' + WORD + r'+\}')}) "
              f"OR contains(t_, '<*>') THEN '<*>' ELSE t_ END)")
    kept = f"list_filter({mapped}, lambda t_: t_ = '<*>' OR {remove_punctuation('t_')} <> '')"
    joined = rx(f"array_to_string({kept}, ' ')", r"<\*>( <\*>)+", "<*>")
    return f"trim({joined}, '.\" ')"


def match_tokens(e: str) -> str:
    return f"list_transform({tokens(e)}, lambda t_: CASE WHEN contains(t_, '<*>') THEN '<*>' ELSE t_ END)"


def format_signature(e: str) -> str:
    return rx(e, "[a-zA-Z0-9]", "")


def star_digits(e: str) -> str:
    return rx(e, DIGIT, "*")


def characters(e: str) -> str:
    return f"(CASE WHEN {e} = '' THEN []::VARCHAR[] ELSE string_split({e}, '') END)"


def jaccard(a: str, b: str) -> str:
    u = f"len(list_distinct(list_concat({a}, {b})))"
    i = f"len(list_intersect({a}, {b}))"
    return f"(CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END)"


def scoring_pieces(e: str) -> str:
    sep = "[" + WS[1:-1] + "".join("\\" + c for c in SCORING_PUNCT) + "]"
    nsep = "[^" + WS[1:-1] + "".join("\\" + c for c in SCORING_PUNCT) + "]"
    return f"regexp_extract_all({e}, {q('(' + sep + '+|' + nsep + '+)')}, 1)"


def scoring_clean(pieces: str) -> str:
    dropped = "".join(c for c in SCORING_PUNCT if c not in SCORING_KEEP) + " "
    drop_class = "[" + "".join("\\" + c for c in dropped) + "]"
    cleaned = (f"list_transform({pieces}, lambda t_: CASE WHEN contains(t_, '<*>') THEN '<*>' "
               f"ELSE {rx('t_', drop_class, '')} END)")
    strip = rx("t_", "^" + WS + "+|" + WS + "+$", "")
    return f"list_transform(list_filter({cleaned}, lambda t_: t_ <> ''), lambda t_: {strip})"


def collapse_wild(list_col: str) -> str:
    return f"list_filter({list_col}, lambda x_, i_: NOT (x_ = '<*>' AND i_ > 1 AND {list_col}[i_ - 1] = '<*>'))"
