"""Regular expressions with the ECMAScript meaning of the escapes.

Java's ``\\b`` looks at Unicode letters and its ``\\s`` knows no no-break space,
so a rule taken over as it stands would fire differently next to an accented
letter.  The escapes are therefore spelled out.
"""

from __future__ import annotations

BOUNDARY = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
SPACE = r"[\t\n\x0B\f\r \xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


# A boundary in front of a word character
_WORD_START = r"(?<![0-9A-Za-z_])"


def java(pattern: str, ignore_case: bool = True) -> str:
    """The pattern for Java.  A leading ``\\b`` must stand before a word character."""
    if pattern.startswith(r"\b"):
        pattern = _WORD_START + pattern[2:]
    spelled = pattern.replace(r"\b", BOUNDARY).replace(r"\s", SPACE).replace(r"\d", "[0-9]")
    return ("(?i)" if ignore_case else "") + spelled
