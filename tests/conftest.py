from datetime import date, datetime

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("strataforge-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def customers(spark):
    names = ["Alice", "Bob", "Charlie", "Diana", "Eve"]
    rows = [(f"C00{i + 1}", n, f"{n.lower()}@example.com", f"+1-555-000{i + 1}", c, datetime(2023, 1, i + 1)) for i, (n, c) in enumerate(zip(names, ["US", "US", "UK", "DE", "FR"]))]
    return spark.createDataFrame(rows, "customer_id string, customer_name string, email string, phone string, country string, created_at timestamp")


@pytest.fixture(scope="session")
def orders(spark):
    buyers, codes, n, total = ["C001", "C001", "C002", "C003", "C004", "C005"], "ABACBA", [2, 1, 3, 1, 2, 1], [100, 50, 150, 75, 100, 50]
    rows = [(f"ORD-00{i + 1}", buyers[i], f"PROD-{codes[i]}", n[i], total[i], date(2023, 2, i + 1)) for i in range(6)]
    return spark.createDataFrame(rows, "order_id string, cust_id string, product_code string, quantity int, total_amount bigint, order_date date")


@pytest.fixture(scope="session")
def order_history(spark):
    end = datetime(9999, 12, 31)
    d = lambda k: datetime(2023, 2, k)
    rows = [("ORD-001", "C001", "pending", 100, d(1), d(3)), ("ORD-001", "C001", "shipped", 100, d(3), end), ("ORD-002", "C001", "pending", 50, d(2), d(4)), ("ORD-002", "C001", "delivered", 50, d(4), end), ("ORD-003", "C002", "pending", 150, d(3), end)]
    return spark.createDataFrame(rows, "order_id string, cust_id string, status string, total_amount bigint, valid_from timestamp, valid_to timestamp")


@pytest.fixture(scope="session")
def sample_tables(customers, orders):
    return {"customers": customers, "orders": orders}
