import base64
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from veilframe.functions import masks


def one(spark, value, mask):
    return spark.createDataFrame([(value,)], "v string").select(mask("v").alias("m")).first()["m"]


@pytest.mark.parametrize(
    ("kind", "value", "want"),
    [
        ("mobile", "13800138000", "138****8000"), ("mobile", "1380013800", "1380013800"), ("mobile", None, None),
        ("id_card", "11010119900101XXXX", "110101********XXXX"), ("id_card", "short", "short"),
        ("name", "Alice", "A**e"), ("name", "Bo", "B*"), ("name", "X", "X**X"), ("name", "", ""), ("name", None, None),
        ("bank_card", "6222021234567890", "6222 **** **** 7890"), ("bank_card", "1234567", "1234567"), ("bank_card", "12345678", "1234 **** **** 5678"),
        ("email", "alice@example.com", "a***@example.com"), ("email", "@x.y", "@x.y"), ("email", "abcdef", "ab**ef"), ("email", "a@b@c", "a***@b@c"),
        ("address", "123456", "123456"), ("address", "1234567", "123456***"),
        ("default", "1234567", "123*567"), ("default", "123456", "123456"),
    ],
)
def test_goldens(spark, kind, value, want):
    assert one(spark, value, masks.MASKS[kind]) == want


def test_kinds():
    assert masks.guess_field_type("email_name") == "name"
    assert masks.guess_field_type("id_card_no") == "id_card"
    assert masks.guess_field_type("USER_PHONE") == "mobile"
    assert masks.guess_field_type("家庭住址") == "address"


@pytest.mark.parametrize("salt", ["k", "x" * 64, "y" * 65, "盐"])
def test_hmac(spark, salt):
    for value in ("sensitive-value", "", "数据"):
        want = base64.b64encode(hmac.new(salt.encode(), value.encode(), hashlib.sha256).digest())[:16].decode()
        assert one(spark, value, lambda c: masks.hmac_token(c, salt)) == want
    with pytest.raises(ValueError):
        masks.hmac_token("v", "")


def test_redact(spark):
    assert one(spark, None, masks.redact) == ""
    assert one(spark, "abc", masks.redact) == "abc***"
    assert one(spark, "123456789", masks.redact) == "12345678***"
    assert one(spark, "abc", lambda c: masks.redact(c, 0)) == "***"
    assert masks.is_sensitive_key("User-EMail") and not masks.is_sensitive_key("segment")


def test_frames(spark):
    df = spark.createDataFrame([("a@b.c", None, 3)], "email string, note string, n int")
    assert masks.mask_dataframe(df, ["email"]).first().asDict() == {"email": "a***@b.c", "note": "", "n": 3}
    got = masks.mask_dataframe(spark.createDataFrame([("a@b.c", "long enough", 3)], "email string, note string, n int"), ["email"], "intended").first()
    assert got["note"] == "long enough"
    batch = spark.createDataFrame([(["name", "x"], ["Bob"])], "n array<string>, v array<string>")
    assert batch.select(masks.mask_batch("n", "v").alias("m")).first()["m"] == ["B**b"]
    m = spark.createDataFrame([({"password": "hunter2hunter2", "x": "y"},)], "m map<string,string>").select(masks.redact_map(F.col("m")).alias("m")).first()["m"]
    assert m == {"password": "hunter2h***", "x": "y"}
