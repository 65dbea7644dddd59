"""Fixed values of the synthetic data: row plan, currencies, countries and other master lists."""

from __future__ import annotations

# Rows of the master tables, independent of scale.
FIXED_ROWS = {
    "currency": 24, "country": 40, "exchange_rate": 2920, "calendar_day": 1096, "tax_rate": 160, "region": 525, "warehouse": 120,
    "product_category": 246, "loyalty_tier": 5, "carrier": 12, "return_reason": 24, "gl_account": 180, "gl_period": 36,
    "app_parameter": 40, "price_list": 48, "promotion": 60,
}

# Rows per unit of scale.
SCALED_ROWS = {
    "address": 1200, "store": 140, "employee": 420, "brand": 60, "product": 1100, "product_variant": 2400, "supplier": 120,
    "supplier_product": 1600, "customer": 2000, "customer_address": 2400, "loyalty_account": 1400, "loyalty_transaction": 2800,
    "price_list_item": 2000, "promotion_product": 300, "coupon": 600, "sales_order": 2400, "sales_order_line": 5600,
    "order_payment": 2600, "shipment": 1600, "shipment_line": 2800, "inventory_location": 800, "inventory_stock": 3200,
    "inventory_movement": 4000, "purchase_order": 600, "purchase_order_line": 1800, "goods_receipt": 1200, "return_request": 280,
    "return_line": 400, "gl_journal": 800, "gl_journal_line": 2400,
}

# Named scales.
TIERS = {"small": 1, "medium": 40, "large": 200}

FACT_START, FACT_DAYS, CALENDAR_DAYS = "2024-01-01", 730, 1096

# Code, name, minor units, symbol.
CURRENCIES = (
    ("GBP", "Pound Sterling", 2, "GBP"), ("EUR", "Euro", 2, "EUR"), ("USD", "US Dollar", 2, "USD"), ("CHF", "Swiss Franc", 2, "CHF"),
    ("DKK", "Danish Krone", 2, "kr"), ("SEK", "Swedish Krona", 2, "kr"), ("NOK", "Norwegian Krone", 2, "kr"), ("ISK", "Icelandic Krona", 0, "kr"),
    ("PLN", "Polish Zloty", 2, "zl"), ("CZK", "Czech Koruna", 2, "Kc"), ("HUF", "Hungarian Forint", 0, "Ft"), ("RON", "Romanian Leu", 2, "lei"),
    ("BGN", "Bulgarian Lev", 2, "lv"), ("CAD", "Canadian Dollar", 2, "CAD"), ("MXN", "Mexican Peso", 2, "MXN"), ("BRL", "Brazilian Real", 2, "BRL"),
    ("ARS", "Argentine Peso", 2, "ARS"), ("CLP", "Chilean Peso", 0, "CLP"), ("AUD", "Australian Dollar", 2, "AUD"), ("NZD", "New Zealand Dollar", 2, "NZD"),
    ("JPY", "Japanese Yen", 0, "JPY"), ("SGD", "Singapore Dollar", 2, "SGD"), ("ZAR", "South African Rand", 2, "R"), ("CNY", "Chinese Yuan", 2, "CNY"),
)

# Code, ISO-3, name, currency, time zone.
COUNTRIES = (
    ("GB", "GBR", "United Kingdom", "GBP", "Europe/London"),
    ("IE", "IRL", "Ireland", "EUR", "Europe/Dublin"),
    ("FR", "FRA", "France", "EUR", "Europe/Paris"),
    ("DE", "DEU", "Germany", "EUR", "Europe/Berlin"),
    ("ES", "ESP", "Spain", "EUR", "Europe/Madrid"),
    ("IT", "ITA", "Italy", "EUR", "Europe/Rome"),
    ("PT", "PRT", "Portugal", "EUR", "Europe/Lisbon"),
    ("NL", "NLD", "Netherlands", "EUR", "Europe/Amsterdam"),
    ("BE", "BEL", "Belgium", "EUR", "Europe/Brussels"),
    ("LU", "LUX", "Luxembourg", "EUR", "Europe/Luxembourg"),
    ("AT", "AUT", "Austria", "EUR", "Europe/Vienna"),
    ("CH", "CHE", "Switzerland", "CHF", "Europe/Zurich"),
    ("DK", "DNK", "Denmark", "DKK", "Europe/Copenhagen"),
    ("SE", "SWE", "Sweden", "SEK", "Europe/Stockholm"),
    ("NO", "NOR", "Norway", "NOK", "Europe/Oslo"),
    ("FI", "FIN", "Finland", "EUR", "Europe/Helsinki"),
    ("IS", "ISL", "Iceland", "ISK", "Atlantic/Reykjavik"),
    ("PL", "POL", "Poland", "PLN", "Europe/Warsaw"),
    ("CZ", "CZE", "Czechia", "CZK", "Europe/Prague"),
    ("SK", "SVK", "Slovakia", "EUR", "Europe/Bratislava"),
    ("HU", "HUN", "Hungary", "HUF", "Europe/Budapest"),
    ("RO", "ROU", "Romania", "RON", "Europe/Bucharest"),
    ("BG", "BGR", "Bulgaria", "BGN", "Europe/Sofia"),
    ("GR", "GRC", "Greece", "EUR", "Europe/Athens"),
    ("HR", "HRV", "Croatia", "EUR", "Europe/Zagreb"),
    ("SI", "SVN", "Slovenia", "EUR", "Europe/Ljubljana"),
    ("EE", "EST", "Estonia", "EUR", "Europe/Tallinn"),
    ("LV", "LVA", "Latvia", "EUR", "Europe/Riga"),
    ("LT", "LTU", "Lithuania", "EUR", "Europe/Vilnius"),
    ("US", "USA", "United States", "USD", "America/New_York"),
    ("CA", "CAN", "Canada", "CAD", "America/Toronto"),
    ("MX", "MEX", "Mexico", "MXN", "America/Mexico_City"),
    ("BR", "BRA", "Brazil", "BRL", "America/Sao_Paulo"),
    ("AR", "ARG", "Argentina", "ARS", "America/Argentina/Buenos_Aires"),
    ("CL", "CHL", "Chile", "CLP", "America/Santiago"),
    ("AU", "AUS", "Australia", "AUD", "Australia/Sydney"),
    ("NZ", "NZL", "New Zealand", "NZD", "Pacific/Auckland"),
    ("JP", "JPN", "Japan", "JPY", "Asia/Tokyo"),
    ("SG", "SGP", "Singapore", "SGD", "Asia/Singapore"),
    ("ZA", "ZAF", "South Africa", "ZAR", "Africa/Johannesburg"),
)

# Tier code, name, least points, discount, multiplier, review months.
LOYALTY_TIERS = (
    ("BRONZE", "Bronze", 0, "0", "1", 12), ("SILVER", "Silver", 2500, "2.5", "1.25", 12), ("GOLD", "Gold", 10000, "5", "1.5", 12),
    ("PLATINUM", "Platinum", 40000, "7.5", "2", 24), ("BLACK", "Black", 150000, "10", "3", 24),
)

# Return reason, description, group, restockable, needs approval.
RETURN_REASONS = (
    ("DAMAGED", "Arrived damaged", "QUALITY", "N", "Y"), ("FAULTY", "Faulty in use", "QUALITY", "N", "Y"),
    ("WRONG_ITEM", "Wrong item shipped", "FULFILMENT", "Y", "N"), ("WRONG_SIZE", "Wrong size", "FIT", "Y", "N"),
    ("TOO_SMALL", "Too small", "FIT", "Y", "N"), ("TOO_LARGE", "Too large", "FIT", "Y", "N"),
    ("NOT_AS_DESC", "Not as described", "EXPECTATION", "Y", "N"), ("CHANGED_MIND", "Changed mind", "EXPECTATION", "Y", "N"),
    ("LATE", "Arrived too late", "FULFILMENT", "Y", "N"), ("DUPLICATE", "Duplicate order", "ORDERING", "Y", "N"),
    ("PRICE_MATCH", "Found cheaper elsewhere", "PRICING", "Y", "N"), ("GIFT_RETURN", "Unwanted gift", "EXPECTATION", "Y", "N"),
    ("MISSING_PART", "Parts missing", "QUALITY", "N", "Y"), ("EXPIRED", "Past best before", "QUALITY", "N", "Y"),
    ("RECALL", "Product recall", "SAFETY", "N", "Y"), ("ALLERGEN", "Allergen labelling", "SAFETY", "N", "Y"),
    ("COLOUR", "Colour not as shown", "EXPECTATION", "Y", "N"), ("QUALITY_LOW", "Quality below expectation", "QUALITY", "Y", "N"),
    ("DELIVERY_DMG", "Damaged in transit", "FULFILMENT", "N", "Y"), ("NEVER_ARRIVED", "Never arrived", "FULFILMENT", "N", "Y"),
    ("WARRANTY", "Warranty claim", "QUALITY", "N", "Y"), ("TRADE_IN", "Trade-in return", "COMMERCIAL", "Y", "Y"),
    ("BULK_REJECT", "Bulk order rejected", "COMMERCIAL", "Y", "Y"), ("OTHER", "Other", "OTHER", "Y", "Y"),
)

CARRIERS = tuple(f"CARRIER{n:02d}" for n in range(1, 13))
FIRST = ("Ada", "Bilal", "Chloé", "Dmitri", "Eleni", "Farah", "Göran", "Hana", "Ivo", "Jun", "Kemal", "Łucja", "María", "Niamh", "Oğuz", "Priya")
LAST = ("Abbott", "Björk", "Castro", "Dvořák", "Ekström", "Fischer", "García", "Horváth", "Ito", "Jansen", "Kowalski", "López", "Moreau", "Novák", "Okafor", "Petrov")
CITY = ("Aarhus", "Bilbao", "Cork", "Dresden", "Espoo", "Firenze", "Ghent", "Haarlem", "Izmir", "Jena", "Köln", "Lyon", "Malmö", "Nantes", "Odense", "Porto")
STREET = ("High Street", "Station Road", "Mill Lane", "Market Square", "Church Walk", "Harbour View", "Park Avenue", "Bridge Street")


def row_plan(scale: str | int) -> dict[str, int]:
    """Rows per table for a named tier or a whole factor."""
    factor = TIERS[scale] if isinstance(scale, str) else int(scale)
    if factor < 1:
        raise ValueError("scale must be at least 1")
    return {**FIXED_ROWS, **{t: n * factor for t, n in SCALED_ROWS.items()}}
