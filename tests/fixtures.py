"""Five small tables: people, departments, regions, sales and a category tree, shaped for the edge cases of SQL."""

from datetime import date

from babelframe.sources.tables import literal_table

EMPLOYEES = [
    (1, "alice", 10, None, 120000, date(2018, 1, 15), True), (2, "bob", 10, 1, 90000, date(2019, 6, 1), True), (3, "carol", 20, None, 150000, date(2017, 3, 20), True),
    (4, "dave", 20, 3, 80000, date(2020, 11, 30), False), (5, "eve", 30, 3, 110000, date(2016, 7, 4), True), (6, "frank", 30, 5, 70000, date(2021, 2, 14), True),
    (7, "grace", 30, 5, None, date(2022, 8, 8), True), (8, "heidi", None, 5, 95000, date(2024, 2, 29), True),
]
DEPARTMENTS = [(10, "Engineering", 1, 1000000), (20, "Sales", 2, 800000), (30, "Research", 1, 1500000), (40, "Marketing", None, 200000)]
REGIONS = [(1, "NA"), (2, "EU"), (3, "APAC")]
SALES = [
    (101, 1, 100, date(2024, 1, 31), 1), (102, 1, 200, date(2024, 2, 29), 1), (103, 2, 50, date(2024, 3, 1), 2), (104, 2, 50, date(2024, 3, 31), 2), (105, 3, 1000, date(2024, 12, 31), 1),
    (106, 3, None, date(2024, 6, 15), 1), (107, 5, 75, date(2024, 7, 4), None), (108, 5, 75, date(2024, 7, 4), None), (109, 5, 25, date(2024, 7, 5), 1), (110, 6, 0, date(2024, 8, 1), 2),
]
CATEGORIES = [(1, "root", None), (2, "electronics", 1), (3, "books", 1), (4, "phones", 2), (5, "computers", 2), (6, "fiction", 3), (7, "laptops", 5)]


def tables(spark):
    t = lambda rows, **c: literal_table(spark, rows, c)
    return {
        "employees": t(EMPLOYEES, id="INT", name="TEXT", dept_id="INT", manager_id="INT", salary="FLOAT", hired_on="DATE", active="BOOL"),
        "departments": t(DEPARTMENTS, id="INT", name="TEXT", region_id="INT", budget="FLOAT"),
        "regions": t(REGIONS, id="INT", name="TEXT"),
        "sales": t(SALES, id="INT", employee_id="INT", amount="FLOAT", sold_on="DATE", region_id="INT"),
        "categories": t(CATEGORIES, id="INT", name="TEXT", parent_id="INT"),
    }
