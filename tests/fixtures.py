"""Small inputs re-typed from the reference's sample files (values only)."""

import datetime as dt


def _d(s):
    return dt.date.fromisoformat(s)


# customer_id, transaction_date, amount, customer_type, product, payment_status, acquisition_cost
TRANSACTIONS = [
    (1, "2026-06-24", 110, "Enterprise", "Analytics", "success", 70),
    (2, "2026-06-26", 140, "SMB", "Security", "success", 45),
    (3, "2026-06-29", 95, "Startup", "Core", "failed", 25),
    (4, "2026-07-02", 180, "Enterprise", "Security", "success", 80),
    (5, "2026-07-05", 130, "SMB", "Core", "success", 50),
    (6, "2026-07-08", 105, "Startup", "Core", "success", 30),
    (7, "2026-07-11", 160, "Enterprise", "Analytics", "success", 75),
    (8, "2026-07-14", 125, "SMB", "Security", "failed", 48),
    (9, "2026-07-17", 100, "Startup", "Core", "success", 28),
    (10, "2026-07-20", 170, "Enterprise", "Security", "success", 82),
    (6, "2026-07-23", 115, "Startup", "Core", "success", 30),
    (7, "2026-07-25", 190, "Enterprise", "Analytics", "success", 75),
    (8, "2026-07-27", 135, "SMB", "Security", "success", 48),
    (9, "2026-07-29", 108, "Startup", "Core", "success", 28),
    (10, "2026-07-31", 175, "Enterprise", "Security", "success", 82),
    (11, "2026-08-02", 145, "SMB", "Analytics", "success", 42),
    (12, "2026-08-04", 98, "Startup", "Core", "success", 24),
    (13, "2026-08-06", 155, "SMB", "Security", "success", 46),
    (14, "2026-08-08", 90, "Startup", "Core", "failed", 22),
    (15, "2026-08-10", 210, "Enterprise", "Analytics", "success", 88),
    (11, "2026-08-12", 152, "SMB", "Analytics", "success", 42),
    (12, "2026-08-13", 102, "Startup", "Core", "success", 24),
    (13, "2026-08-14", 165, "SMB", "Security", "success", 46),
    (14, "2026-08-15", 96, "Startup", "Core", "success", 22),
    (15, "2026-08-16", 205, "Enterprise", "Analytics", "success", 88),
    (6, "2026-08-17", 118, "Startup", "Core", "success", 30),
    (7, "2026-08-18", 198, "Enterprise", "Analytics", "failed", 75),
    (8, "2026-08-19", 142, "SMB", "Security", "success", 48),
    (9, "2026-08-20", 112, "Startup", "Core", "success", 28),
    (10, "2026-08-20", 182, "Enterprise", "Security", "success", 82),
]


def transactions(spark):
    rows = [(i, c, _d(t), a, ct, p, s, ac) for i, (c, t, a, ct, p, s, ac) in enumerate(TRANSACTIONS)]
    return spark.createDataFrame(rows, "row_id long, customer_id long, transaction_date date, amount bigint, "
                                       "customer_type string, product string, payment_status string, acquisition_cost bigint")


SEGMENTS = [
    (1, "Enterprise", "Analytics", 1200, 2, 0), (2, "Enterprise", "Analytics", 1500, 4, 0),
    (3, "Enterprise", "Security", 1800, 3, 0), (4, "Enterprise", "Security", 2100, 5, 1),
    (5, "Small", "Analytics", 180, 1, 0), (6, "Small", "Analytics", 220, 2, 0),
    (7, "Small", "Security", 160, 4, 1), (8, "Small", "Security", 200, 5, 1),
    (9, "Medium", "Analytics", 600, 2, 0), (10, "Medium", "Analytics", 720, 3, 0),
    (11, "Medium", "Security", 680, 6, 1), (12, "Medium", "Security", 750, 7, 1),
]

PROFILES = [
    (1, "Enterprise", 165000, 0, 1, 510), (2, "Enterprise", 152000, 0, 2, 470), (3, "Enterprise", 171000, 0, 1, 540),
    (4, "Enterprise", 149000, 0, 3, 430), (5, "Enterprise", 158000, 0, 4, 365), (6, "SMB", 12000, 0, 3, 220),
    (7, "SMB", 9000, 0, 4, 200), (8, "SMB", 11000, 1, 5, 170), (9, "SMB", 8000, 1, 6, 150),
    (10, "SMB", 10000, 0, 4, 190), (11, "SMB", 9500, 1, 5, 165), (12, "Startup", 2600, 0, 5, 130),
    (13, "Startup", 2300, 0, 6, 120), (14, "Startup", 1900, 1, 7, 95), (15, "Startup", 2400, 0, 5, 125),
    (16, "Startup", 2100, 1, 8, 90), (17, "Startup", 2500, 0, 4, 140), (18, "Startup", 1800, 1, 7, 85),
    (19, "Startup", 2200, 0, 6, 115),
]

CORRELATION = [
    (1, 12, 2, 1, 0), (2, 18, 3, 2, 0), (3, 25, 4, 2, 0), (4, 31, 5, 3, 0), (5, 38, 6, 4, 0), (6, 45, 7, 5, 0),
    (7, 52, 8, 6, 1), (8, 60, 9, 7, 1), (9, 68, 10, 8, 1), (10, 76, 11, 9, 1), (11, 84, 12, 10, 1), (12, 92, 13, 11, 1),
]

# viewer_id, user_name, country, subscription_plan, monthly_fee, watch_duration_minutes, completion_rate, viewing_date, churn
MISSING = [
    ("V101", "Alice Johnson", "US", "Premium", 15.99, 45.0, 0.90, "2025-01-01", 0),
    ("V102", "Bob Smith", "CA", "Standard", 11.99, None, 0.65, "2025-01-02", 0),
    ("V103", None, "UK", None, 8.99, 12.5, 0.35, "2025-01-03", 1),
    (None, "Unknown User", "US", "Basic", 8.99, 25.0, 0.50, "2025-01-04", 0),
    ("V105", "David Brown", "US", "Premium", None, 80.0, 0.95, None, 0),
    ("V106", "Eva Green", "AU", "Standard", 11.99, 30.0, None, "2025-01-06", 0),
    ("V107", "Frank White", None, "Premium", 15.99, 55.0, 0.85, "2025-01-07", 0),
    (None, "Missing ID", "CA", "Standard", 11.99, 20.0, 0.40, "2025-01-08", 1),
    ("V109", "Grace Hopper", "US", "Basic", 8.99, None, 0.70, "2025-01-09", 0),
    ("V110", "Henry Ford", "UK", "Standard", 11.99, 60.0, 0.80, "2025-01-10", 0),
]

# viewer_id, user_name, content_id, watch_date, watch_duration, completion_rate, subscription_status
DUPLICATES = [
    ("V101", "Alice Johnson", "C201", "2025-01-15", 45.0, 0.90, "Active"),
    ("V101", "Alice Johnson", "C201", "2025-01-15", 45.0, 0.90, "Active"),
    ("V102", "Bob Smith", "C202", "2025-01-16", 20.0, 0.40, "Active"),
    ("V102", "Bob Smith", "C202", "2025-01-16", 20.0, None, "Active"),
    ("V103", "Elena Rostova", "C203", "2025-01-17", 50.0, 1.00, "Cancelled"),
    ("V104", "Marcus Vance", "C204", "2025-01-18", 60.0, 0.95, "Active"),
    ("V104", "Marcus Vance", "C204", "2025-01-18", 65.0, 1.00, "Active"),
    ("V105", "David Brown", "C205", "2025-01-19", 35.0, 0.70, "Active"),
    ("V105", "David Brown", "C205", "2025-01-19", 35.0, 0.70, "Active"),
    ("V106", "Eva Green", "C206", "2025-01-20", 15.0, 0.30, "Active"),
]

# viewer_id, user_name, signup_date, monthly_fee, watch_duration, auto_renew, churn, plan (all text)
UNSTANDARDISED = [
    ("V101", " Alice Johnson ", "2025-01-10", "$15.99", "42.5", "1", "0", "Premium"),
    ("V102", "Bob Smith", "2025-01-14", "$11.99", "18.2", "true", "0", "standard"),
    ("V103", "Elena Rostova", "2025-01-22", "$8.99", "5.0", "0", "1", "BASIC"),
    ("V104", "Marcus Vance", "2025-02-01", "$15.99", "64.0", "yes", "0", "PREMIUM"),
    ("V105", "David Brown", "2025-02-15", "$1,200.50", "120.5", "T", "0", "Standard"),
    ("V106", "Eva Green", "2025-02-28", "$11.99", "30.0", "0", "1", "standard"),
    ("V107", "Frank White", "2025-03-05", "$15.99", "55.0", "False", "0", "Premium"),
    ("V108", "Grace Hopper", "2025-03-12", "$8.99", "8.5", "1", "0", "Basic"),
]

DAILY_REVENUE = [100, 105, 98, 110, 102, 108, 104, 112, 107, 115, 109, 118, 111, 120, 114, 122, 116, 125, 119, 128, 121,
                 130, 124, 133, 127, 136, 129, 138, 132, 141, 135, 142, 148, 145, 152, 149, 156, 153, 160, 157, 164, 161,
                 168, 165, 172, 169, 176, 173, 180, 177, 184, 181, 188, 185, 192, 189, 196, 193, 200, 190, 185, 188, 180,
                 183, 175, 178, 170, 173, 165, 168, 160, 163, 155, 158, 150, 153, 145, 148, 140, 143, 135, 138, 130, 133,
                 125, 128, 120, 123, 115, 118]
DAILY_ORDERS = [10, 11, 9, 12, 10, 11, 10, 12, 11, 12, 11, 13, 11, 13, 12, 13, 12, 14, 12, 14, 13, 14, 13, 15, 13, 15, 14,
                15, 14, 16, 14, 15, 16, 15, 17, 16, 17, 16, 18, 17, 18, 17, 19, 18, 19, 18, 20, 19, 20, 19, 21, 20, 21, 20,
                22, 21, 22, 21, 23, 21, 20, 20, 19, 20, 18, 19, 18, 18, 17, 18, 17, 17, 16, 17, 16, 16, 15, 16, 15, 15, 14,
                15, 14, 14, 13, 14, 13, 13, 12, 13]


def daily(spark):
    start = dt.date(2025, 1, 1)
    rows = [(start + dt.timedelta(days=i), r, o) for i, (r, o) in enumerate(zip(DAILY_REVENUE, DAILY_ORDERS))]
    return spark.createDataFrame(rows, "date date, revenue bigint, orders bigint")


SAMPLE = [(1, "Alice Smith", 150.50, "2025-01-15"), (2, "Bob Johnson", 200.00, "2025-01-20"),
          (3, "Carol White", 75.25, "2025-02-01")]
