from pyspark.sql import functions as F

from driftlog.functions.encryption import decrypt_fields, encrypt_fields

KEY = b"0123456789abcdef0123456789abcdef"


def test_round_trip(spark):
    df = spark.createDataFrame([(1, "Ada", None), (2, "", "é" * 50)], "id long, name string, mail string")
    sealed = encrypt_fields(df, ["name", "mail"], KEY)
    assert sealed.where(F.col("name") == "Ada").count() == 0 and sealed.where("__encrypted = 1").count() == 2
    assert sorted(map(tuple, decrypt_fields(sealed, ["name", "mail"], KEY).collect())) == sorted(map(tuple, df.collect()))
