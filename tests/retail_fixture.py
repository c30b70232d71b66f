"""A small retail schema with the edge cases the corpus has to get right."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

D = Decimal


def ts(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


ROWS = {
    "customers": (
        "customer_id string, company_name string, contact_name string, city string, country string, phone string",
        [
            ("ALFKI", "Alfreds", "Maria", "Berlin", "Germany", "030-1"),
            ("BONAP", "Bon app", "Laurence", "Marseille", "France", "a@b.c"),
            ("CACTU", "Cactus", None, "Lima", "Peru", None),  # no orders
        ],
    ),
    "suppliers": (
        "supplier_id int, company_name string, contact_name string, city string",
        [(1, "Exotic", "Ann", "London"), (2, "Alfreds", "Maria", "Berlin")],
    ),
    "categories": ("category_id int, category_name string", [(1, "Beverages"), (2, "Produce")]),
    "products": (
        "product_id int, product_name string, supplier_id int, category_id int, unit_price decimal(19,4), "
        "units_in_stock smallint, reorder_level smallint, discontinued boolean",
        [
            (1, "Chai", 1, 1, D("18.0000"), 10, 10, False),  # stock equals reorder level
            (2, "Chang", 1, 1, D("19.0000"), 0, 25, False),  # active and out of stock
            (3, "Tofu", 2, 2, D("19.0000"), 35, 0, False),  # ties with Chang
            (4, "Ham", 2, 2, D("40.0000"), 0, 0, True),  # discontinued and out of stock
            (5, "Gift", 2, 2, D("0.0000"), 5, 0, False),  # free
        ],
    ),
    "shippers": ("shipper_id int, company_name string", [(1, "Speedy"), (2, "United")]),
    "employees": (
        "employee_id int, last_name string, first_name string, country string, reports_to int",
        [(1, "Davolio", "Nancy", "USA", 2), (2, "Fuller", "Andrew", "USA", None), (3, "King", None, "UK", 2)],
    ),
    "orders": (
        "order_id int, customer_id string, employee_id int, order_date timestamp_ntz, "
        "required_date timestamp_ntz, shipped_date timestamp_ntz, ship_via int, freight decimal(19,4)",
        [
            (1, "ALFKI", 1, ts("1997-01-05"), ts("1997-01-20"), ts("1997-01-10"), 1, D("10.5000")),
            (2, "BONAP", 1, ts("1997-12-31T00:00"), ts("1998-01-20"), ts("1997-12-31T00:00"), 2, D("1.0000")),
            (3, "BONAP", 2, ts("1997-12-31T12:00"), ts("1998-01-01"), ts("1998-02-01"), 2, None),  # late
            (4, None, 2, ts("1998-03-01"), ts("1998-04-01"), None, 1, D("2.0000")),  # no customer, open
        ],
    ),
    "order_details": (
        "order_id int, product_id int, unit_price decimal(19,4), quantity smallint, discount float",
        [
            (1, 1, D("18.0000"), 10, 0.0), (1, 2, D("19.0000"), 1, 0.15), (2, 3, D("23.2500"), 3, 0.25),
            (3, 4, D("40.0000"), 2, 0.0), (3, 99, D("5.0000"), 1, 0.0),  # product 99 does not exist
        ],
    ),
    "territories": ("territory_id string, territory_description string, region_id int", [("01", "North", 1), ("02", "South", 1)]),
    "employee_territories": ("employee_id int, territory_id string", [(1, "01"), (1, "02"), (2, "01"), (2, "01")]),
}


def retail(spark) -> dict:
    return {name: spark.createDataFrame(rows, schema) for name, (schema, rows) in ROWS.items()}
