"""Values that several test modules share. Not in conftest.py: each test folder has one of its own."""

from datetime import datetime, timezone

AS_OF = datetime(2026, 8, 10, tzinfo=timezone.utc)


def site_uuid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"
