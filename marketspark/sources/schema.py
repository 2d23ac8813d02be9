"""Fixed schemas; no reader infers types."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

LISTING_FILE = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("listingdate", T.DateType()),
        T.StructField("saledate", T.DateType()),
        T.StructField("amount", MONEY),
        T.StructField("hometype", T.StringType()),
        T.StructField("undercontract", T.IntegerType()),
    ]
)

STREET_STOCK_FILE = T.StructType(
    [T.StructField("streetname", T.StringType()), T.StructField("numberofhomes", T.IntegerType())]
)

CATEGORY_FILE = T.StructType(
    [T.StructField("hometype", T.StringType()), T.StructField("hometypeAB", T.StringType())]
)

PROCESSED_FILE = T.StructType(
    [
        T.StructField("address", T.StringType()),
        T.StructField("listingdate", T.DateType()),
        T.StructField("saledate", T.DateType()),
        T.StructField("amount", T.LongType()),
        T.StructField("hometype", T.StringType()),
        T.StructField("undercontract", T.IntegerType()),
        T.StructField("inventory", T.LongType()),
        T.StructField("listingcount", T.LongType()),
        T.StructField("listingyear", T.IntegerType()),
        T.StructField("listingmonth", T.IntegerType()),
        T.StructField("saleyear", T.IntegerType()),
        T.StructField("salemonth", T.IntegerType()),
        T.StructField("dayofyear", T.IntegerType()),
        T.StructField("timeonmarket", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("yearlysales", T.LongType()),
        T.StructField("inventorytime", T.DoubleType()),
    ]
)
