"""Masking rules: patterns that replace volatile parts of a body by a token."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values. Ids, labels, categories, tokens, word lists and the text each
# pattern accepts decide the results, so they are part of the contract.
# ---------------------------------------------------------------------------

CATEGORIES = ["Network", "Identity", "Web", "System", "Security"]

MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
WEEKDAYS = "Mon|Tue|Wed|Thu|Fri|Sat|Sun"
METHODS = "GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|TRACE|CONNECT"
AGENTS = (
    "mozilla|chrome|safari|firefox|edg|opera|bot|crawler|spider|slurp|curl|wget|python|"
    "go-http|postman|java|mobile|android|iphone|ipad|dalvik|cfnetwork|darwin"
)
AGENT_INITIALS = "ABCDEFGIJMOPSWabcdefgijmopsw"

CLOCK = r"[0-9]{2}:[0-9]{2}:[0-9]{2}"
FRACTION = r"(?:\.[0-9]+)?"
DATE_TIME = (
    rf"[0-9]{{4}}[-/.][0-9]{{2}}[-/.][0-9]{{2}}[T\s]{CLOCK}{FRACTION}"
    r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
)
COMMON_LOG = rf"[0-9]{{2}}/(?:{MONTHS})/[0-9]{{4}}:{CLOCK}\s[+-][0-9]{{4}}"
SYSLOG = (
    rf"(?:(?:{WEEKDAYS})[,\s]+)?(?:{MONTHS})\s+[0-9]{{1,2}}\s+{CLOCK}{FRACTION}"
    r"(?:\s+[A-Z]{3,5})?"
)
EPOCH = r"[12][0-9]{9}(?:[0-9]{3})?"

NAME = r"[\w.-]+"
H4 = r"[0-9a-fA-F]{1,4}"
HEX = "[0-9a-fA-F]"
FREE_LEFT = "(?<![a-zA-Z0-9])"
FREE_RIGHT = "(?![a-zA-Z0-9])"
B64 = r"[A-Za-z0-9_=-]+"


# An edge between word and other characters. Spelled out, because the engine's own word
# boundary is Unicode in some Java releases and ASCII in others.
EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _word(first: str, inner: str) -> str:
    """``inner`` between edges. Looking at its first character first is what makes a rule
    cheap on the many positions where it does not apply."""
    return rf"(?=[{first}])(?<!\w)(?:{inner})(?!\w)"


@dataclass(frozen=True)
class MaskRule:
    id: str
    label: str
    category: str
    token: str
    pattern: str
    default: bool
    description: str
    examples: tuple[str, ...]


RULES: tuple[MaskRule, ...] = (
    MaskRule(
        "timestamp_all", "Any Timestamp", "System", "<TIMESTAMP>",
        _word("0-9A-Z", f"{DATE_TIME}|{COMMON_LOG}|{SYSLOG}|{EPOCH}"), True,
        "Dates with times in ISO-like, access-log and syslog style, and epoch numbers",
        ("2024-03-05T06:07:08Z", "2024/03/05 06:07:08", "05/Mar/2024:06:07:08 +0000",
         "Tue Mar 05 06:07:08.250 UTC", "1709618828"),
    ),
    MaskRule(
        "pid", "Process / Thread ID", "System", "<PID>",
        "|".join(
            (
                _word("ptPT", r"(?:pid|tid|PID|TID)\s+[0-9]+"),
                r"\[pid [0-9]+\]",
                _word("0-9", "[0-9]+#[0-9]+"),
            )
        ),
        True,
        "Process and thread numbers of error lines",
        ("[pid 311]", "tid 17", "2048#3"),
    ),
    MaskRule(
        "file_path", "File System Path", "System", "<FILE_PATH>",
        r"(?:/[\w.-]++){3,}+", False,
        "Paths of at least three segments, URL paths included",
        ("/srv/app/data/7.bin",),
    ),
    MaskRule(
        "hex_address", "Hex / Memory Address", "System", "<HEX_ADDR>",
        _word("0", rf"0x{HEX}+"), False,
        "Hexadecimal pointers",
        ("0x7ffe10a4",),
    ),
    MaskRule(
        "semver", "Semantic Version", "System", "<VERSION>",
        r"(?=[v0-9])(?<!\w)v?[0-9]+\.[0-9]+\.[0-9]+(?:-[a-zA-Z0-9.-]+)?(?:\+[a-zA-Z0-9.-]+)?"
        + EDGE,
        False,
        "Three-part versions with pre-release and build parts",
        ("v3.11.0", "1.0.0-beta.2"),
    ),
    MaskRule(
        "number", "Generic Numbers", "System", "<NUM>",
        _word("0-9", "[0-9]{3,}"), False,
        "Any free-standing number of three or more digits",
        ("404", "65536"),
    ),
    MaskRule(
        "database_url", "Database Connection URL", "System", "<DB_URL>",
        rf"(?=[pmr])(?:postgres|mysql|mongodb(?:\+srv)?|redis)://(?:[^:]+:[^@]+@)?{NAME}(?::[0-9]+)?(?:/{NAME})?",
        True,
        "Database URLs with credentials, port and database name",
        ("postgres://app:pw@db.internal:5432/shop", "redis://cache:6379"),
    ),
    MaskRule(
        "ipv4", "IPv4 Address", "Network", "<IP_ADDRESS>",
        _word("0-9", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"), True,
        "Four dotted numbers",
        ("192.0.2.44",),
    ),
    MaskRule(
        "ipv6", "IPv6 Address", "Network", "<IPV6_ADDRESS>",
        rf"{FREE_LEFT}(?={HEX}{{0,4}}:)(?:"
        rf"(?:{H4}:){{1,6}}(?::{H4}){{1,6}}|(?:{H4}:){{1,7}}{H4}|(?:{H4}:){{1,7}}:|"
        rf"::(?:{H4}:){{0,6}}{H4}){FREE_RIGHT}",
        False,
        "Full addresses and addresses shortened in the middle, at the end or at the start",
        ("2001:db8::7", "fe80::", "::1"),
    ),
    MaskRule(
        "mac_address", "MAC Address", "Network", "<MAC_ADDRESS>",
        _word("0-9a-fA-F", rf"(?:{HEX}{{2}}[:-]){{5}}{HEX}{{2}}"), False,
        "Six hex pairs joined by colons or dashes",
        ("02:42:ac:11:00:02",),
    ),
    MaskRule(
        "port", "Port Number", "Network", "<PORT>",
        r"(?<=:)[1-9][0-9]{0,4}(?!\w)(?!\.[0-9])", True,
        "Number of up to five digits after a colon",
        (":8443",),
    ),
    MaskRule(
        "email", "Email Address", "Identity", "<EMAIL>",
        r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", False,
        "Mail addresses",
        ("ops@example.org",),
    ),
    MaskRule(
        "uuid", "UUID / GUID", "Identity", "<UUID>",
        _word("0-9a-fA-F", rf"{HEX}{{8}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{4}}-{HEX}{{12}}"), False,
        "Identifiers of 8-4-4-4-12 hex digits",
        ("123e4567-e89b-42d3-a456-426614174000",),
    ),
    MaskRule(
        "trace_id", "Trace / Span ID", "Identity", "<TRACE_ID>",
        _word("0-9a-fA-F", rf"{HEX}{{32}}|{HEX}{{16}}"), False,
        "Hex strings of exactly 32 or 16 characters",
        ("0af7651916cd43dd8448eb211c80319c", "b7ad6b7169203331"),
    ),
    MaskRule(
        "http_method", "HTTP Method", "Web", "<HTTP_METHOD>",
        _word("CDGHOPT", METHODS), True,
        "Upper-case request methods",
        ("PATCH",),
    ),
    MaskRule(
        "http_numeric_id", "HTTP Path Numeric ID", "Web", "<ID>",
        r"""(?<=/)[0-9]{2,}(?=[/?#\s"']|$)""", False,
        "Path segments made of two or more digits",
        ("/items/4711",),
    ),
    MaskRule(
        "query_string", "URL Query String", "Web", "?<QUERY>",
        r"""\?[^\s"']+""", False,
        "Everything from the question mark of a URL on",
        ("?k=17&sort=asc",),
    ),
    MaskRule(
        "user_agent_all", "Any User-Agent", "Web", '"<USER_AGENT>"',
        rf'"(?=[^"]*")[^"]*?(?=[{AGENT_INITIALS}])(?i:{AGENTS})[^"]*"', True,
        "Quoted text naming a browser, bot, phone or command line client",
        ('"curl/8.5.0"', '"Mozilla/5.0 (X11; Linux x86_64)"'),
    ),
    MaskRule(
        "bearer_token", "Bearer Token", "Security", "Bearer <TOKEN>",
        rf"(?i)bearer\s+{B64}\.{B64}\.?[A-Za-z0-9_.+/=-]*", False,
        "Values of authorization headers",
        ("Bearer abc.def.ghi",),
    ),
    MaskRule(
        "api_key", "API Key / Secret", "Security", "<API_KEY>",
        r"""(?i)(?:api[_-]?key|token|secret|password)[\s:=]+["']?[A-Za-z0-9+/_-]{16,64}["']?""",
        False,
        "Keys, tokens, secrets and passwords of 16 to 64 characters with their name",
        ("api_key=0123456789abcdef0123",),
    ),
    MaskRule(
        "jwt", "JSON Web Token (JWT)", "Security", "<JWT>",
        rf"(?=e)(?<!\w)eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+{EDGE}", False,
        "Three-part signed tokens",
        ("eyJhbGciOi.eyJzdWIiOi.c2lnbmF0dXJl",),
    ),
)

RULE = {r.id: r for r in RULES}
DEFAULT_IDS: tuple[str, ...] = tuple(r.id for r in RULES if r.default)

#: What counts as a mask token inside a template.
TOKEN_PATTERN = r"<[A-Z_0-9]+>"


def select_masks(ids: Iterable[str] | None = None) -> tuple[str, ...]:
    """A mask selection as a caller states it: order kept, unknown ids refused."""
    chosen = DEFAULT_IDS if ids is None else tuple(ids)
    unknown = [i for i in chosen if i not in RULE]
    if unknown:
        raise ValueError(f"unknown mask ids: {unknown}")
    return chosen


def apply_masks(col: Column, ids: Iterable[str] | None = None) -> Column:
    """Rules in the order given, each over the output of the one before.

    Ids that name no rule are skipped. Word, digit and boundary classes are ASCII.
    """
    for rule_id in DEFAULT_IDS if ids is None else ids:
        rule = RULE.get(rule_id)
        if rule is not None:
            col = F.regexp_replace(col, F.lit(rule.pattern), F.lit(rule.token))
    return col


def mask_labels(template: Column, ids: Iterable[str] | None = None) -> Column:
    """Labels of the selected rules whose whole token occurs in the template."""
    rules = [RULE[i] for i in (DEFAULT_IDS if ids is None else ids) if i in RULE]
    if not rules:
        return F.array().cast("array<string>")
    found = [F.when(F.contains(template, F.lit(r.token)), F.lit(r.label)) for r in rules]
    return F.array_compact(F.array(*found))


def template_tokens(template: Column) -> Column:
    """Mask tokens of a template in order, for highlighting."""
    return F.regexp_extract_all(template, F.lit(TOKEN_PATTERN), F.lit(0))
