"""What the tests of orders share, under a name that no other folder's conftest can take."""

from datetime import datetime, timedelta, timezone

REF = datetime(2026, 1, 1, tzinfo=timezone.utc)


def ago(days=0, hours=0, ref=REF):
    return ref - timedelta(days=days, hours=hours)


def by_key(df, key="cliente_id"):
    return {r[key]: r for r in df.collect()}
