"""Message and template columns (F1-F13) as native Spark Column expressions.

Every function takes and returns a ``Column``; nothing here runs Python per
row. Regexes start with ``(?U)`` so that ``\\w``, ``\\s`` and ``\\d`` follow
Unicode classes the way Python's ``re`` does on ``str``.

Token-level rules (F8, F9) run as regex passes over single-spaced text. A pass
that can only match where a certain character stands is skipped for texts
without it. An expression that is used several times is bound with :func:`once`,
as Spark would evaluate it for each use. Where a lambda needs the previous
element (F12) the array is zipped with a shifted copy of itself instead of
being referenced inside the lambda.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for identical results.
# ASCII punctuation, as Python's string.punctuation:
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Weekday and month abbreviations masked by mask_message, in this order:
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun",
          "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
# Literal rewrites of correct_message, in this order:
MESSAGE_REWRITES = [
    ("logname uid", "logname null uid"),
    ("ruser rhost", "ruser null rhost"),
    ("invalid user from", "invalid_user from"),
]
# mask_message patterns, in this order (path, email, direction, MAC,
# digit-bearing word, site, weekday, month). A match of the three with a
# lookbehind can only begin where it says; saying so spares a long word a new
# attempt at each of its characters.
MASK_PATTERNS = [
    r"/\S+",
    r"(?<!\w)\w+@\S+",
    r"(\w\+|\w-)",
    r"(\w{2}:){5}\w{2}",
    r"(?<!\S)\S*\d\S*",
    r"(?<!\S)\S+\.(com|net|\w{2})",
    "(" + "|".join(WEEKDAYS) + ")",
    "(" + "|".join(MONTHS) + ")",
]
# One of these characters stands in every match of the mask pattern (empty: not known).
MASK_NEEDS = ["/", "@", "+-", ":", "", ".", "", ""]
# correct_template rewrites, in this order:
TEMPLATE_RULES = [
    (r"\d+:\d+", "{time}"),
    (r"(0x|0)[a-fA-F0-9]+", "{hex_code}"),
    (r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}", "{ip_address}"),
    (r"([0-9a-fA-F]{2}:){5}[0-9a-fA-F]{2}", "{mac_address}"),
    (r"\S+@\S+", "{email}"),
    (r"(=|==)\S+", "{unknown}"),
]
# One of these characters stands in every match of the rewrite.
RULE_NEEDS = [":", "0", ".", ":", "@", "="]
# Characters treated as separators by the scoring tokenizer (no '*', '<', '>'):
SCORING_PUNCT = "!\"#$%&'()+,-/:;=?@.[\\]^_`{|}~"
# Separator characters kept inside scoring tokens:
SCORING_KEEP = "=|()"
# Token separators of the match tokenizer:
TOKEN_SPLIT = r"[ ,|{}]"
WILDCARD = "<*>"


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(c, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``c``, evaluated once per row however often ``use`` takes it."""
    return F.get(F.transform(F.array(_col(c)), use), F.lit(0))


def _replaced(c, pattern: str, repl: str, needs: str = "") -> Column:
    """Regex replacement; texts without any of the characters ``needs`` stay as they are."""
    if not needs:
        return F.regexp_replace(_col(c), pattern, repl)
    return once(c, lambda x: F.when(reduce(or_, [F.contains(x, F.lit(n)) for n in needs]),
                                    F.regexp_replace(x, pattern, repl)).otherwise(x))


def _regex_class(chars: str) -> str:
    return "[" + "".join("\\" + ch for ch in chars) + "]"


def remove_punctuation(c) -> Column:
    """delete the 32 ASCII punctuation characters."""
    return F.translate(_col(c), PUNCTUATION, "")


def squeeze_spaces(c) -> Column:
    return F.regexp_replace(_col(c), _u(r"\s+"), " ")


def strip_whitespace(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_col(c), _u(r"^\s+|\s+$"), "")


def correct_message(c) -> Column:
    """literal rewrites, ``...`` to a space, squeeze whitespace, strip ``.`` and space."""
    c = _col(c)
    for old, new in MESSAGE_REWRITES:
        c = F.replace(c, F.lit(old), F.lit(new))
    c = _replaced(c, r"\.{3,}", " ", ".")
    c = squeeze_spaces(c)
    return F.btrim(c, F.lit(". "))


def collapse_adjacent_duplicates(c) -> Column:
    """Collapse runs of equal space-separated tokens (input already single-spaced)."""
    return F.regexp_replace(_col(c), _u(r"(?<!\S)(\S+)(?: \1(?!\S))+"), "$1")


def mask_message(c) -> Column:
    """the masked key used for exact matching and deduplication."""
    c = _col(c)
    for pattern, needs in zip(MASK_PATTERNS, MASK_NEEDS):
        c = _replaced(c, _u(pattern), "{Var}", needs)
    c = F.replace(c, F.lit("{Var} "), F.lit("{Var}"))
    c = F.regexp_replace(c, r"(\{Var\})+", "{Var}")
    c = remove_punctuation(c)
    c = squeeze_spaces(c)
    c = collapse_adjacent_duplicates(c)
    return F.trim(c)


def zero_digits(c) -> Column:
    """Every ASCII digit as ``0``: messages that differ in their numbers become equal.
    Masks (F2) and alphabetic tokens see only whether a character is a digit, and no
    masked key holds one, so both are the same for the message and for this text."""
    return F.translate(_col(c), "123456789", "000000000")


def words(c) -> Column:
    """Python ``str.split()`` — whitespace split without empty strings."""
    return F.filter(F.split(_col(c), _u(r"\s+")), lambda x: x != "")


def star_numbers(c) -> Column:
    return F.regexp_replace(_col(c), _u(r"\d+(\.\d+)?"), "*")


def tokens(c) -> Column:
    """match tokens of one message.

    Split on space, comma, pipe and braces; a word with exactly one ``=``
    keeps its left side (digits kept), more ``=`` drop it; a word with ``/`` is
    dropped; other words get numbers starred. Empty result falls back to the
    whole message with numbers starred.
    """
    def one(w):
        n_eq = F.length(w) - F.length(F.replace(w, F.lit("="), F.lit("")))
        return (F.when(n_eq == 1, F.substring_index(w, "=", 1))
                .when(n_eq >= 2, F.lit(None).cast("string"))
                .when(w.contains("/"), F.lit(None).cast("string"))
                .otherwise(star_numbers(w)))

    def all_of(s):
        kept = F.filter(F.transform(F.split(s, TOKEN_SPLIT), one), lambda x: x.isNotNull() & (x != ""))
        return once(kept, lambda k: F.when(F.size(k) == 0, F.array(star_numbers(s))).otherwise(k))

    return once(c, all_of)


def message_tokens(c) -> Column:
    """tokens of the normalised message."""
    return tokens(correct_message(c))


def format_signature(c) -> Column:
    """the message with ASCII letters and digits removed."""
    return F.regexp_replace(_col(c), "[a-zA-Z0-9]", "")


def star_digits(c) -> Column:
    """every digit to ``*``."""
    return F.regexp_replace(_col(c), _u(r"\d"), "*")


def _previous(arr: Column) -> Column:
    """``arr`` shifted right by one, first element ``''`` (same length)."""
    return F.slice(F.concat(F.array(F.lit("")), arr), 1, F.size(arr))


def single_spaced(c) -> Column:
    """Python ``" ".join(s.split())``: whitespace runs to one space, ends trimmed."""
    return F.trim(squeeze_spaces(c))


# Token-level rewrites on single-spaced text. ``(?<![^ ])`` anchors at a token
# start and ``[^ ]*`` runs to its end; lookbehinds read the original input, so
# "previous token" means the token before any rewrite, as in the reference.
_AFTER_EQUALS = _u(r"(?<=(?:^| )==? )[^ ]+")
_NUMBER_TOKEN = _u(r"(?<![^ ])[^\w ]*\d[^ ]*")
_PATH_TOKEN = _u(r"(?<![^ ])[^\w ]*(?:file:|folder:)*/+[^ ][^ ]*")
_SLOT_TOKEN = _u(r"(?<![^ ])[^ ]*?(?:\{\w+\}|<\*>)[^ ]*")
_PUNCT_TOKEN = r"(?<![^ ])(?!<\*>(?![^ ]))[!-/:-@\[-`{-~]+(?![^ ])"


def rule_label(c) -> Column:
    """F8 (correct_template): rule-based labelling of a message or response.

    Ordered rewrites, then per whitespace token: after an original ``=``/``==``
    token -> ``{unknown}``; a token starting with digits -> ``{number}``; a
    path-like token -> ``{file_path}``. Tokens are re-joined by one space.
    Implemented as regex passes over the single-spaced text (no arrays).
    """
    c = _col(c)
    for (pattern, repl), needs in zip(TEMPLATE_RULES, RULE_NEEDS):
        c = _replaced(c, _u(pattern), repl, needs)
    c = single_spaced(c)
    c = _replaced(c, _AFTER_EQUALS, "{unknown}", "=")
    c = _replaced(c, _NUMBER_TOKEN, "{number}")
    return _replaced(c, _PATH_TOKEN, "{file_path}", "/")


def canonical_template(c) -> Column:
    """F9 (process_template): slots to ``<*>``, drop punctuation-only tokens,
    collapse adjacent ``<*>``, strip ``.``, ``"`` and spaces at the ends."""
    s = _replaced(single_spaced(c), _SLOT_TOKEN, WILDCARD, "{<")
    s = single_spaced(F.regexp_replace(s, _PUNCT_TOKEN, ""))
    s = _replaced(s, r"<\*>( <\*>)+", WILDCARD, "<")
    return F.btrim(s, F.lit('." '))


def match_tokens(c) -> Column:
    """F10 (post_process): template tokens with every ``<*>``-bearing token as ``<*>``."""
    return F.transform(tokens(c), lambda x: F.when(x.contains(WILDCARD), F.lit(WILDCARD)).otherwise(x))


def repair_response(msg, resp) -> Column:
    """F11 (insertion_process): prefer the message when the response contains it,
    apply F8, and if every token is a slot restore a digit-free first log word."""
    def finish(m, labelled, t):
        first = F.get(words(m), 0)
        all_slots = F.forall(t, lambda x: x.rlike(r"\{.*\}"))
        restore = all_slots & (F.size(t) > 0)
        rebuilt = lambda f: F.array_join(
            F.concat(F.array(f), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0)))), " ")
        return F.when(restore, once(first, lambda f: F.when(
            f.isNotNull() & ~f.rlike(_u(r"\d")), rebuilt(f)).otherwise(labelled))).otherwise(labelled)

    def chosen(m):
        resp_or_msg = once(resp, lambda r: F.when(F.instr(r, m) > 0, m).otherwise(r))
        return once(rule_label(resp_or_msg), lambda labelled: once(words(labelled), lambda t: finish(m, labelled, t)))

    return once(msg, chosen)


def scoring_tokens(c) -> Column:
    """F12 (message_split + post_process_tokens): split on separator runs,
    keeping them; ``<*>``-bearing tokens become ``<*>``; remove punctuation and
    spaces except ``= | ( )``; drop empties; strip; collapse adjacent ``<*>``."""
    sep = "[\\s" + "".join("\\" + ch for ch in SCORING_PUNCT) + "]"
    pieces = F.regexp_extract_all(_col(c), F.lit(_u(f"({sep}+|[^{sep[1:]}+)")), 1)
    dropped = "".join(ch for ch in SCORING_PUNCT if ch not in SCORING_KEEP) + " "
    cleaned = F.transform(
        pieces, lambda x: F.when(x.contains(WILDCARD), F.lit(WILDCARD)).otherwise(F.translate(x, dropped, "")))
    stripped = F.transform(F.filter(cleaned, lambda x: x != ""), strip_whitespace)
    return F.filter(
        once(stripped, lambda s: F.zip_with(
            s, _previous(s), lambda x, prev: F.when((x == WILDCARD) & (prev == WILDCARD), F.lit(None)).otherwise(x))),
        lambda x: x.isNotNull())


def fold_wildcards(c) -> Column:
    """Tokens of a single-space split with any ``<*>``-bearing token as ``<*>``."""
    return F.transform(F.split(_col(c), " "),
                       lambda x: F.when(x.contains(WILDCARD), F.lit(WILDCARD)).otherwise(x))


def templates_equal_folded(truth, parsed) -> Column:
    """P8 (correct_lstm): truth tokens folded to ``<*>`` equal parsed tokens."""
    return fold_wildcards(truth) == F.split(_col(parsed), " ")


def slot_labels(c) -> Column:
    """Labels of ``{label}`` slots in order (lazy braces, like ``\\{(.*?)\\}``)."""
    return F.regexp_extract_all(_col(c), F.lit(r"\{(.*?)\}"), 1)
