"""Safety of names that are put into SQL."""

from __future__ import annotations

import re

from .errors import IdentifierError

# Words that can't name a table, schema or column.
RESERVED = frozenset(
    "SELECT FROM WHERE INSERT UPDATE DELETE DROP CREATE ALTER TABLE INDEX VIEW PROCEDURE FUNCTION TRIGGER DATABASE SCHEMA USER ROLE GRANT REVOKE JOIN UNION ORDER GROUP HAVING AS ON IN EXISTS BETWEEN LIKE AND OR NOT NULL IS LEVEL SIZE TYPE RESOURCE CHECK UNIQUE WITH VALUES".split()
)
MAX_LENGTH = 128


def check_identifier(name: str, what: str) -> str:
    """The name, if it is safe; raises IdentifierError otherwise."""
    if not name or not name.strip():
        raise IdentifierError(f"{what} cannot be empty")
    if len(name) > MAX_LENGTH:
        raise IdentifierError(f"{what} '{name}' is longer than {MAX_LENGTH} characters")
    if not re.fullmatch(r"[A-Za-z][A-Za-z0-9_$#]*", name):
        raise IdentifierError(f"{what} '{name}' has characters that aren't allowed: a letter, then letters, digits, _, $ or #")
    if name.upper() in RESERVED:
        raise IdentifierError(f"{what} '{name}' is a reserved word")
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
