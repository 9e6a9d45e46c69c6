"""Small deterministic tables with known faults."""

from __future__ import annotations

CUSTOMERS, ORDERS, PRODUCTS = 60, 240, 40


def retail(spark):
    """Clean tables with four true relationships."""
    make = spark.createDataFrame
    return {
        "customers": make([(i, f"c{i}@x.org", f"First{i % 7}", i % 2 == 0) for i in range(1, CUSTOMERS + 1)], "CustomerID int, Email string, FirstName string, IsActive boolean"),
        "suppliers": make([(i, f"SUP-{i:04d}", f"Supplier {i}") for i in range(1, 26)], "SupplierID int, SupplierCode string, SupplierName string"),
        "products": make([(i + 1000, f"SKU{i:05d}", 1 + i % 25, 9.99 + i) for i in range(1, PRODUCTS + 1)], "ProductID int, SKU string, SupplierID int, UnitPrice double"),
        "orders": make([(i + 50000, f"ON{i:06d}", 1 + (i * 7) % CUSTOMERS, "EUR") for i in range(ORDERS)], "OrderID int, OrderNumber string, CustomerID int, Currency string"),
        "order_lines": make([(i + 900000, 50000 + i % ORDERS, 1001 + (i * 3) % PRODUCTS, 1 + i % 5) for i in range(600)], "OrderLineID int, OrderID int, ProductID int, Quantity int"),
    }


TRUE_EDGES = {("orders", "CustomerID", "customers", "CustomerID"), ("products", "SupplierID", "suppliers", "SupplierID"), ("order_lines", "OrderID", "orders", "OrderID"), ("order_lines", "ProductID", "products", "ProductID")}


def faulty(spark):
    """Orphans, nulls, placeholders, repeated rows and childless parents."""
    make = spark.createDataFrame
    orders = [(i, None if i % 20 == 0 else 0 if i % 3 == 0 else 999999 if i % 50 == 1 else 1 + i % 30, float(i % 9), i % 3) for i in range(300)]
    return {
        "customers": make([(i, f"n{i}", i == 0) for i in range(40)], "customer_id int, customer_name string, is_dummy boolean"),
        "orders": make(orders + orders[:12], "order_id int, customer_id int, amount double, status int"),
        "identities": make([(i, f"m{i // 2}@x.org", 100 + i) for i in range(40)], "customer_id int, email string, crm_customer_id int"),
    }
