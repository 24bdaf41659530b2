"""Texts that must equal the program this repository matches."""

# The header every member-order file must have, in this order.
ORDER_HEADER = ["Pickup Site", "First Name", "Last Name", "Order"]

# Tokens that mean "no share this week, only extra items".
ORDER_ONLY_ITEMS = [
    "1 No Share - Order Only (even wk)",
    "1 No Share - Order Only (odd wk)",
    "1 No Produce - Order Only (even wk)",
    "1 No Produce - Order Only (odd wk)",
]

# The food groups a standard share can be set for.
FOOD_GROUPS = ["A", "H", "C", "M", "U"]

# Marker texts.
PICKUP_MARK = "Pickup Time"
POT_PLANT_MARK = "Pot Plant"
HOME_DELIVERY_MARK = "Home Delivery -"
HOME_DELIVERY_PREFIX = "Home Delivery - "
STANDARD_LABEL = "STANDARD SHARE ITEMS"
GROUP_SORT_TEXT = "....."

# Rows of a printed page.
PAGE_ROWS = 46

# Default label rules (match, text, freeform text, emoji).
LABEL_RULES = [
    ("contains", "Milk - 2%", "*", "\U0001F404"),
    ("contains", "Milk - Chocolate", "*", "\U0001F404"),
    ("contains", "Milk - Creamline", "*", "\U0001F404"),
    ("contains", "Milk - Skim", "*", "\U0001F404"),
    ("contains", "Milk - Whole", "*", "\U0001F404"),
    ("contains", "2% MILK", "*", "\U0001F404"),
    ("contains", "Chocolate MILK", "*", "\U0001F404"),
    ("contains", "Creamline MILK", "*", "\U0001F404"),
    ("contains", "Skim MILK", "*", "\U0001F404"),
    ("contains", "Whole MILK", "*", "\U0001F404"),
    ("contains", "Whole Milk - o", "*", "\U0001F404"),
    ("contains", "64 Oz. Heavy Cream", "*", "\U0001F404"),
    ("contains", "Pizza - Cheese", "**", "\U0001F355"),
    ("contains", "Pizza - Deluxe", "**", "\U0001F355"),
    ("contains", "Pizza - Four Meat", "**", "\U0001F355"),
    ("contains", "Pizza - Hot Chicken", "**", "\U0001F355"),
    ("contains", "Pizza - Pepperoni", "**", "\U0001F355"),
    ("contains", "Pizza - Sausage Pepperoni", "**", "\U0001F355"),
    ("contains", "Pizza - Tomato Basil Garlic", "**", "\U0001F355"),
    ("contains", "Pizza - Veggie", "**", "\U0001F355"),
    ("contains", "Schlafly Beer", "***", "\U0001F37A"),
    ("contains", "Pre-ordered Plants", "***", "\U0001F331"),
]

# Default format rules (match, text, decoration, colour).
FORMAT_RULES = [
    ("equal", "STANDARD SHARE ITEMS", "bold", None),
    ("contains", "Pickup Time", "italic", None),
]

# Words that keep a keyword-lookup row.
LOOKUP_WORDS = ["beer", "plant", "pizza", "food", "vege", "cow", "chicken", "fish", "shrimp", "cheese"]
