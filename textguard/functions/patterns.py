"""Recognisers R1-R16 as data.

Each recogniser is a Java regular expression plus metadata. ``(?U)`` makes ``\\w``,
``\\b``, ``\\d`` and ``\\s`` Unicode-aware, which is how the original (Python ``str``)
patterns behave; ``(?iU)`` adds Unicode case folding where the original ignores case.
The ``gate`` is a literal every match must contain; rows without it skip the regex.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Recognizer:
    etype: str
    pattern: str
    gate: str | None = None      # literal substring every match contains
    check: str | None = None     # "iban" | "tax_id" | "phone_digits"
    secret: bool = False


# ---------------------------------------------------------------------------
# FIXED VALUES - recogniser patterns, entity type names and detection order.
# They must equal the original rules for identical results (described in
# ---------------------------------------------------------------------------
EMAIL = Recognizer("EMAIL_ADDRESS", r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", gate="@")
IBAN = Recognizer("IBAN_CODE", r"(?U)(?<![A-Za-z0-9])[A-Za-z]{2}\d{2}(?:[A-Za-z0-9][ -]?){10,34}(?![A-Za-z0-9])", check="iban")
TAX_ID = Recognizer("GERMAN_TAX_ID", r"(?U)(?<!\d)\d{11}(?!\d)\b", check="tax_id")
PHONE_E164 = Recognizer("PHONE_NUMBER", r"(?U)(?<!\w)\+[1-9]\d{1,14}(?!\w)", gate="+")
PHONE_LOCAL = Recognizer("PHONE_NUMBER", r"(?U)(?<!\w)(?:0049|0043|0)[\s./-]?\d(?:[\s./-]?\d){6,14}(?!\w)", gate="0")
PLATE = Recognizer("GERMAN_LICENSE_PLATE", r"(?iU)\b[A-ZÄÖÜ]{1,3}-[A-Z]{1,2}\s?\d{1,4}[EH]?\b", gate="-")
PERSONAL_ID = Recognizer("PERSONAL_ID", r"(?iU)\b[CFGHJKLMNPRTVWXYZ]\d{8}\b")
PERSON = Recognizer(
    "PERSON",
    r"(?U)\b(?:Herr|Frau|Mr\.?|Ms\.?|Mrs\.?|M\.?|Mme\.?|Monsieur|Madame|Sig\.?|Sig\.ra|Signor|Signora"
    r"|Sr\.?|Sra\.?|Señor|Señora)\s+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+(?:\s+[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ]+)?\b",
)
AWS_KEY = Recognizer("AWS_KEY", r"AKIA[0-9A-Z]{16}", gate="AKIA", secret=True)
ANTHROPIC_KEY = Recognizer("ANTHROPIC_KEY", r"sk-ant-[a-zA-Z0-9_-]{20,}", gate="sk-ant-", secret=True)
OPENAI_KEY = Recognizer("OPENAI_KEY", r"sk-[a-zA-Z0-9_-]{20,}", gate="sk-", secret=True)
GITHUB_TOKEN = Recognizer("GITHUB_TOKEN", r"ghp_[a-zA-Z0-9]{36}", gate="ghp_", secret=True)
PRIVATE_KEY = Recognizer("PRIVATE_KEY", r"-----BEGIN (?:RSA|EC|OPENSSH|DSA|PRIVATE)(?: PRIVATE)? KEY-----", gate="-----BEGIN ", secret=True)
JWT_TOKEN = Recognizer("JWT_TOKEN", r"eyJ[a-zA-Z0-9_-]+\.eyJ[a-zA-Z0-9_-]+\.[a-zA-Z0-9_-]+", gate="eyJ", secret=True)
CONNECTION_STRING = Recognizer("CONNECTION_STRING", r"(?U)(?:postgres|mysql|mongodb|redis)://[^\s]+", gate="://", secret=True)
# Runs after all others and keeps only matches with 8-15 digits in total.
PHONE_FORMATTED = Recognizer("PHONE_NUMBER", r"(?U)(?<!\w)\+[1-9](?:[\s()./-]?\d){5,18}(?!\w)", gate="+", check="phone_digits")

BUILTIN = (
    EMAIL, IBAN, TAX_ID, PHONE_E164, PHONE_LOCAL, PLATE, PERSONAL_ID, PERSON,
    AWS_KEY, ANTHROPIC_KEY, OPENAI_KEY, GITHUB_TOKEN, PRIVATE_KEY, JWT_TOKEN, CONNECTION_STRING,
    PHONE_FORMATTED,
)

SECRET_TYPES = (
    "AWS_KEY", "ANTHROPIC_KEY", "OPENAI_KEY", "GITHUB_TOKEN", "PRIVATE_KEY", "JWT_TOKEN", "CONNECTION_STRING",
)

CUSTOM_TYPE = "CUSTOM"

# Detector mode names reported per language in the audit snapshot.
MODE_EXTERNAL = "presidio"
MODE_REGEX = "regex_fallback"

SUPPORTED_LANGUAGES = ("de", "en", "fr", "it", "es")
STRATEGIES = ("placeholder", "redact", "hash")
SECRET_POLICIES = ("mask", "block")

# Limits of the original service, in bytes or counts.
MAX_TEXT_BYTES = 100 * 1024
MAX_ENTITIES = 1_000
MAX_TERMS = 50
MAX_TERM_BYTES = 100
MAX_LITERAL_MATCHES = 1_000

# IBAN length per country (ISO 13616 registry), alphabetical.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22,
    "BH": 22, "BI": 16, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18,
    "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27,
    "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27,
    "MT": 31, "MU": 30, "MZ": 25, "NI": 32, "NL": 18, "NO": 15, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31,
    "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SN": 28, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
# ---------------------------------------------------------------------------

# Opt-in (not in the original rules): the whole PEM block, header to footer, as one PRIVATE_KEY span.
PRIVATE_KEY_BLOCK = Recognizer(
    "PRIVATE_KEY",
    r"-----BEGIN (?:RSA|EC|OPENSSH|DSA|PRIVATE)(?: PRIVATE)? KEY-----(?:(?!-----END )[\s\S])*+-----END [A-Z ]*KEY-----"
    r"|-----BEGIN (?:RSA|EC|OPENSSH|DSA|PRIVATE)(?: PRIVATE)? KEY-----",
    gate="-----BEGIN ", secret=True)


def builtin(mask_pem_body: bool = False) -> tuple[Recognizer, ...]:
    """The built-in rules; ``mask_pem_body`` swaps the header-only PEM rule for the block rule."""
    if not mask_pem_body:
        return BUILTIN
    return tuple(PRIVATE_KEY_BLOCK if r is PRIVATE_KEY else r for r in BUILTIN)
