"""Parameters of the registered queries (the fixture's reference day and slices)."""
AS_OF = "2001-07-18"          # a Wednesday with rows in the test data
MONTH = (2001, 7)
H1_2001 = ("2001-01-01", "2001-06-30")
JULY_2001 = ("2001-07-01", "2001-07-31")
DATE_CLAMP_TEST = ("1992-01-01", "2025-01-31")   # the fixed 2017.. clamp would drop all test rows
TEST_CATEGORIES = ("ECONOMY", "LARGE", "PROMO", "STANDARD")   # in place of the shoe list

TOPICS_SQL = "('내구성 및 품질', '디자인', '사이즈', '가성비', '착용감', '배송 및 포장 및 응대')"


def rounded(x: str, digits: int) -> str:
    """Oracle text: a double at ``digits`` places by its exact binary value (half to even), as Python's ``round``."""
    return f"CAST(format('{{:.{digits}f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"
