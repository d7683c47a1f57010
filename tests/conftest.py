from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from convops.session import get_session  # noqa: E402
from convops.sources.binding import Tables  # noqa: E402
from convops.sources.schemas import SCHEMAS  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session("local[4]", 4, app_name="convops-tests",
                    extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="convops-test-ckpt-")})
    yield s


def ts(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text)


def D(x) -> decimal.Decimal:
    return decimal.Decimal(str(x)).quantize(decimal.Decimal("0.01"))


# The reference's sample rows (its only test input), ids in insert order from 1.
SEED_ROWS = {
    "tier": [(1, "Free", D(0), 100, "N"), (2, "Plus", D(20), 1000, "Y"), (3, "Enterprise", D(100), 99999, "Y")],
    "support_agent": [(1, "Alice", "alice@support.llm", "Billing", ts("2023-01-15")),
                      (2, "Bob", "bob@support.llm", "Account", ts("2023-06-01"))],
    "llm_user": [(1, 1, "Carol", "carol@example.com", ts("2024-01-10"), "English"),
                 (2, 2, "Dave", "dave@example.com", ts("2024-02-20"), "English"),
                 (3, 3, "Eva", "eva@example.com", ts("2024-03-05"), "German")],
    "billing_record": [(1, "Credit Card", "UofA, Tucson AZ"), (2, "PayPal", "ASU, Tempe AZ"),
                       (3, "Credit Card", "Parliament, UK")],
    "invoice": [(1, 2, 2, ts("2024-03-01"), D(20), "Paid"), (2, 3, 3, ts("2024-04-01"), D(100), "Unpaid")],
    "workspace": [(1, 3, "google", "SHARED", ts("2024-03-10 09:00:00"))],
    "workspace_member": [(1, 3, "OWNER", ts("2024-03-10 09:00:00")), (1, 2, "MEMBER", ts("2024-03-15 11:00:00"))],
    "persona": [(1, 3, "SWE", "you are software architect", ts("2024-03-12 10:00:00")),
                (2, 3, "writer", "you are writing coach", ts("2024-03-20 14:00:00"))],
    "conversation": [
        (1, 3, 1, 1, "Microservices Discussion", ts("2024-04-01 10:00:00"), "ACTIVE", "SWE", "you are software architect"),
        (2, 1, None, 2, "Short Story Help", ts("2024-06-25 14:00:00"), "ACTIVE", "writer", "you are writing coach"),
        (3, 2, None, None, "General Chat", ts("2024-07-01 12:00:00"), "ARCHIVED", None, None)],
    "message": [(1, 1, "USER", ts("2024-04-01 10:01:00"), "pros and cons of iphone?"),
                (2, 1, "AI", ts("2024-04-01 10:01:30"), "pros: cool. cons: expensive"),
                (3, 2, "USER", ts("2024-06-25 14:01:00"), "opening line for a sci-fi."),
                (4, 2, "AI", ts("2024-06-25 14:01:25"), "spaceballs"),
                (5, 3, "USER", ts("2024-07-01 12:01:00"), "hi"),
                (6, 3, "AI", ts("2024-07-01 12:01:10"), "hello")],
    "message_feedback": [(1, 2, "Thumbs Up", "not wrong", ts("2024-04-01 10:05:00")),
                         (2, 4, "Thumbs Down", "nede more", ts("2024-06-25 14:05:00"))],
    "message_bookmark": [(1, 2, ts("2024-04-02 08:00:00"))],
    "prompt_template": [(1, 3, "code review", "review code for correctness", "engineering", "SHARED",
                         ts("2024-04-10 09:00:00")),
                        (2, 2, "summary", "summarize this short:", "personal", "PRIVATE", ts("2024-05-20 11:00:00"))],
    "workspace_prompt_template": [(1, 1, ts("2024-04-11 08:00:00"))],
    "support_ticket": [(1, 1, None, "Billing", ts("2024-07-10 10:00:00"), None, "Open"),
                       (2, 3, 1, "Account", ts("2024-06-20 08:00:00"), ts("2024-06-21 10:00:00"), "Resolved")],
}


def make_tables(spark, rows: dict[str, list]) -> Tables:
    frames = {name: spark.createDataFrame(rows.get(name, []), SCHEMAS[name]) for name in SCHEMAS}
    return Tables(spark, {name: (lambda d: (lambda _t: d))(df) for name, df in frames.items()})


@pytest.fixture(scope="session")
def seed(spark) -> Tables:
    return make_tables(spark, SEED_ROWS)


def rows(df, *cols):
    """Collected rows as tuples (of the given columns), sorted for order-insensitive comparison."""
    sel = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in sel.collect()), key=repr)
