"""Pattern, priority and weight tables of the detectors (Java regular expressions)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Spec:
    recognizer: str
    entity_type: str
    data_class: str
    confidence: float
    state: str
    pattern: str
    group: int = 0  # 0, or the group that ends the match
    cue: str = ""  # a text without this cannot match

    @property
    def gate(self) -> str:
        """A cheap pattern that every text with a match has too; '' if the cue is enough."""
        return GATES.get((self.recognizer, self.entity_type, self.group, self.cue), "")

    @property
    def look(self) -> str:
        """The one of ``LOOKS`` that every text with a match has; '' if none is needed."""
        if self.entity_type in ("IBAN", "MONEY"):
            return {"IBAN": "digit"}.get(self.entity_type, "money")
        if self.entity_type == "IP_ADDRESS":
            return "digit" if self.recognizer == "legacy-regex" else ""
        return "digits" if self.entity_type in ("INN", "SNILS", "PASSPORT", "CARD_NUMBER", "PHONE") else ""


# Patterns, confidences, classes, priorities and weights that results depend on.
SECRETS = (
    Spec("secrets", "JWT", "AUTH_SECRET", 0.98, "VALID", r"(?<![\w-])eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?![\w-])", 0, "eyJ"),
    Spec("secrets", "CONNECTION_STRING", "AUTH_SECRET", 0.98, "VALID", r"(?iu)(?<!\w)[a-z][a-z0-9+.-]*://[^\s:/@<>\"']+:[^\s/@<>\"']+@[^\s<>\"']+", 0, "://"),
    Spec("secrets", "PRIVATE_KEY", "AUTH_SECRET", 0.98, "VALID", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----", 0, "-----BEGIN "),
)
STRUCTURED = (
    Spec("structured-identifiers", "INN", "DIRECT_PII", 0.995, "VALID", r"(?iu)(?<!\w)(?:ИНН|tax\s+id)[^\d\r\n]{0,32}(\d{10}|\d{12})(?!\d)", 1),
    Spec("structured-identifiers", "SNILS", "DIRECT_PII", 0.995, "VALID", r"(?iu)(?<!\d)(?:СНИЛС\s*[:№#]?\s*)?(\d{3}-\d{3}-\d{3}\s?\d{2})(?!\d)", 1, "-"),
    Spec("structured-identifiers", "IBAN", "FINANCIAL", 0.995, "VALID", r"(?<![A-Z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Z0-9])"),
    Spec("structured-identifiers", "PASSPORT", "DIRECT_PII", 0.94, "UNVALIDATED", r"(?iu)\bпаспорт\s*[:№#]?\s*(?:серия\s*)?(\d{4}\s*[,;]?\s*(?:номер|№|#)?\s*\d{6})(?!\d)", 1),
)
_H = "[0-9A-Fa-f]{1,4}"
_SHORT = "|".join((f"{_H}(?::{_H}){{{n - 1}}}" if n else "") + (f"::(?:{_H}(?::{_H}){{0,{6 - n}}})?" if n < 7 else "::") for n in range(8))
NETWORK = (
    Spec("network-address", "IP_ADDRESS", "QUASI_IDENTIFIER", 0.995, "VALID", rf"(?<![0-9A-Za-z:])(?=[0-9A-Fa-f:]{{3}})(?:{_H}(?::{_H}){{7}}|{_SHORT})(?![0-9A-Za-z:])", 0, ":"),
)
BARE_PASSPORT = Spec("structured-identifiers", "PASSPORT", "DIRECT_PII", 0.58, "AMBIGUOUS", r"(?<!\d)(\d{4}\s+\d{6})(?!\d)", 1)
LEGACY = (
    Spec("legacy-regex", "API_KEY", "AUTH_SECRET", 0.82, "UNVALIDATED", r"(?iu)\b(?:sk-[a-z0-9_-]{16,}|rk-[a-z0-9_-]{16,}|ghp_[a-z0-9]{20,}|github_pat_[a-z0-9_]{20,}|xox[baprs]-[a-z0-9-]{10,}|AKIA[0-9A-Z]{16}|AIza[0-9A-Za-z_-]{20,})\b"),
    Spec("legacy-regex", "API_KEY", "AUTH_SECRET", 0.82, "UNVALIDATED", r"(?isu)\b(?:api[_ -]?key|access[_ -]?token|auth[_ -]?token|secret|password|passwd)\s*[:=]\s*[\"']?([A-Za-z0-9_./+=-]{12,})", 1),
    Spec("legacy-regex", "URL", "QUASI_IDENTIFIER", 0.97, "VALID", r"(?iu)\bhttps?://[^\s<>\"']+", 0, "://"),
    Spec("legacy-regex", "EMAIL", "DIRECT_PII", 0.97, "VALID", r"(?iu)(?<![\w.+-])[a-z0-9.!#$%&'*+/=?^_`{|}~-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)+(?![\w-])", 0, "@"),
    Spec("legacy-regex", "FILE_PATH", "BUSINESS_CONFIDENTIAL", 0.82, "UNVALIDATED", r"(?<![\w])(?:[A-Za-z]:\\|\\\\)(?:[^\\/:*?\"<>|\r\n]+\\)+[^\\/:*?\"<>|\r\n]+?\.[A-Za-z0-9]{1,10}(?![\w])", 0, "\\"),
    Spec("legacy-regex", "FILE_PATH", "BUSINESS_CONFIDENTIAL", 0.82, "UNVALIDATED", r"(?<![\w:])/(?:[^\s/<>\"']+/)+[^\s/<>\"']+", 0, "/"),
    Spec("legacy-regex", "CARD_NUMBER", "FINANCIAL", 0.99, "VALID", r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"),
    Spec("legacy-regex", "INN", "DIRECT_PII", 0.99, "VALID", r"(?iu)(?<![\w-])ИНН\s*(\d{10,12})(?!\d)", 1),
    Spec("legacy-regex", "IP_ADDRESS", "QUASI_IDENTIFIER", 0.97, "VALID", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w])", 0, "."),
    Spec("legacy-regex", "PHONE", "DIRECT_PII", 0.82, "UNVALIDATED", r"(?<!\w)(?:\+?\d[\d\s()\-]{7,}\d)(?!\w)"),
    Spec("legacy-regex", "MONEY", "FINANCIAL", 0.82, "UNVALIDATED", r"(?iux)(?<!\w)(?:\d+|\d{1,3}(?:[,.\s]\d{3})+)(?:[,.]\d{2})?\s?(?:USD|EUR|GBP|RUB|руб\.?|долл\.?|доллар(?:ов|а|ы)?|евро|руб(?:лей|ля|ль)?)(?!\w)"),
    Spec("legacy-regex", "MONEY", "FINANCIAL", 0.82, "UNVALIDATED", r"(?iux)(?<!\w)(?:[$€£₽]\s?\d{1,3}(?:[,.\s]\d{3})*(?:[,.]\d{2})?|\d{1,3}(?:[,.\s]\d{3})*(?:[,.]\d{2})?\s?(?:USD|EUR|GBP|RUB|руб\.?|долл\.?|евро))(?!\w)"),
    Spec("legacy-regex", "DOMAIN", "QUASI_IDENTIFIER", 0.82, "UNVALIDATED", r"(?iu)(?<![@\w.-])(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}(?::\d{2,5})?(?![\w-])", 0, "."),
    Spec("legacy-regex", "PERSON", "DIRECT_PII", 0.82, "UNVALIDATED", r"(?<![\w-])(?!(?:Автор|Контакт|Клиент|Пользователь|Господин|Госпожа|Мистер|Миссис)\b)(?:[А-ЯЁ][а-яё'’-]+\s+)(?:[А-ЯЁ][а-яё'’-]+)(?:\s+[А-ЯЁ][а-яё'’-]+)?(?![\w-])"),
)
PRIORITY = {
    "PRIVATE_KEY": 120, "CONNECTION_STRING": 118, "JWT": 116, "API_KEY": 114, "URL": 105, "EMAIL": 100, "IBAN": 98, "CARD_NUMBER": 96,
    "INN": 94, "SNILS": 94, "PASSPORT": 92, "FILE_PATH": 90, "PHONE": 80, "IP_ADDRESS": 78, "MONEY": 70, "DOMAIN": 60, "PERSON": 50,
}
THRESHOLDS = {"FAST": 0.85, "BALANCED": 0.65, "STRICT": 0.45}
RISK_WEIGHTS = {
    "PUBLIC_DATA": 5, "QUASI_IDENTIFIER": 30, "LOCATION": 35, "BUSINESS_CONFIDENTIAL": 45, "DIRECT_PII": 55, "FINANCIAL": 70, "HEALTH": 75, "AUTH_SECRET": 90,
}
TRAILING = ".,;:!?)]}>"
# Fixed values end.

#: Cheap patterns by recognizer, type, group and cue: parts that every match contains.
_CURRENCY = r"\p{Nd}\s?[UuEeGgRrРрДдЕе\u1C81]"
GATES = {
    ("secrets", "CONNECTION_STRING", 0, "://"): r"://[^\s:/@<>\"']+:",
    ("structured-identifiers", "INN", 1, ""): r"\p{Nd}{10}",
    ("structured-identifiers", "SNILS", 1, "-"): r"\p{Nd}{3}-\p{Nd}{3}-\p{Nd}{3}",
    ("structured-identifiers", "IBAN", 0, ""): r"[A-Z]{2}\p{Nd}{2}",
    ("structured-identifiers", "PASSPORT", 1, ""): r"\p{Nd}{6}",
    ("network-address", "IP_ADDRESS", 0, ":"): r":[0-9A-Fa-f]{0,4}:",
    # The ends of the prefixes, found at their last character; k, s and i have other cases beyond ASCII.
    ("legacy-regex", "API_KEY", 0, ""): r"[-_](?<=[kKbaprsBAPRS\u212A\u017F]-|[pPtT]_)|[aA](?:[kK\u212A][iI\u0130\u0131]|[iI\u0130\u0131][zZ])[aA]",
    ("legacy-regex", "API_KEY", 1, ""): r"[:=]\s*[\"']?[A-Za-z0-9_./+=-]{12}",
    ("legacy-regex", "FILE_PATH", 0, "/"): r"/[^\s/<>\"']+/",
    ("legacy-regex", "CARD_NUMBER", 0, ""): r"(?:\p{Nd}[ -]?){12}\p{Nd}",
    ("legacy-regex", "INN", 1, ""): r"\p{Nd}{10}",
    ("legacy-regex", "IP_ADDRESS", 0, "."): r"\p{Nd}\.\p{Nd}{1,3}\.",
    ("legacy-regex", "PHONE", 0, ""): r"\p{Nd}[\p{Nd}\s()\-]{7}",
    ("legacy-regex", "DOMAIN", 0, "."): r"\.(?<=[A-Za-z0-9]\.)[A-Za-z0-9]",
    ("legacy-regex", "PERSON", 0, ""): r"[А-ЯЁ][а-яё'’-]+\s+[А-ЯЁ]",
}

#: What several patterns need, looked for once in a text: its pattern, and the look that it needs itself.
LOOKS = {
    "digit": (r"\p{Nd}", ""),
    "digits": (r"\p{Nd}[\p{Nd}\s()\-]{5}", "digit"),
    "money": (r"[$€£₽]|" + _CURRENCY, "digit"),
}
