"""Fixed values of the extraction rules: word lists, patterns, units and categories, in the order in which they apply."""

from __future__ import annotations


# Keyword list of the record profile, with the spellings that count for some.
KEYWORDS = [
    "organic", "vegan", "kosher", "gluten free", "keto", "imported", "premium", "gourmet", "refill", "bundle", "case", "exotic", "luxury",
    "natural", "sugar free", "low fat", "plant-based", "whole grain",
]
SYNONYMS = {
    "gluten free": ["gluten-free", "gluten free"],
    "sugar free": ["sugar-free", "sugar free", "no sugar"],
    "plant-based": ["plant based", "plant-based"],
    "whole grain": ["wholegrain", "whole grain"],
    "low fat": ["low-fat", "low fat"],
}
# Keyword list of the text-flag profile.
FLAG_KEYWORDS = [
    "organic", "vegan", "kosher", "gluten free", "keto", "imported", "premium", "gourmet", "refill", "bundle", "case", "hot sauce",
    "cereal", "tea", "coffee", "candy", "spice", "cosmetics", "cleaning",
]

# Categories (names hold commas, so one a line), the fallback, and the rules in their order.
CATEGORIES = [
    "Beverages", "Grains & Pasta", "Snacks & Sweets", "Condiments, Sauces & Spices", "Canned & Packaged Goods", "Baking Supplies",
    "Dairy & Dairy Alternatives", "Breakfast Foods", "Oils, Vinegars & Dressings", "Produce (Packaged & Dried)",
    "Meat & Seafood (Shelf-Stable)", "Health & Wellness Foods", "Baby Food", "Frozen Foods", "International & Gourmet Foods",
]
FALLBACK = "Uncategorized"
CATEGORY_RULES: list[tuple[str, list[str]]] = [
    ("Snacks & Sweets", [
        "pringles", "fritos", "cheetos", "doritos", "ruffles", "lay's", "lays",
    ]),
    ("Meat & Seafood (Shelf-Stable)", [
        "starkist", "bumble bee", "chicken of the sea",
    ]),
    ("Beverages", [
        "coffee", "espresso", "latte", "cappuccino", "k-cup", "kcup", "k cup", "instant coffee", "creamer", "espresso capsules", "k-cups",
        "pods",
    ]),
    ("Beverages", [
        "tea", "herbal tea", "green tea", "iced tea", "chai", "jasmine", "oolong", "rooibos", "yerba mate", "matcha",
    ]),
    ("Beverages", [
        "water", "tonic", "sparkling", "seltzer", "mineral water", "alkaline water",
    ]),
    ("Beverages", [
        "juice", "nectar", "cider", "lemonade", "smoothie",
    ]),
    ("Beverages", [
        "soda", "cola", "pop", "soft drink", "energy drink", "sports drink",
    ]),
    ("Snacks & Sweets", [
        "pretzel", "chips", "chip", "crisps", "candy", "gummi", "gummy", "chocolate", "cookie", "cracker", "popcorn", "trail mix", "nuts",
        "peanuts", "almonds", "cashews", "hazelnuts", "pecans", "pistachios", "walnuts", "snack", "gum", "mints", "lollipop", "taffy",
        "fudge",
    ]),
    ("Condiments, Sauces & Spices", [
        "ketchup", "mustard", "mayo", "mayonnaise", "hot sauce", "sauce", "spice", "seasoning", "cumin", "pepper", "salt", "herb",
        "bouillon", "rub", "marinade", "pesto", "dressing", "vinaigrette",
    ]),
    ("Canned & Packaged Goods", [
        "bean", "beans", "soup", "noodle", "pouch", "can", "canned", "packaged", "pasta sauce", "fruit cocktail", "pineapple", "cherry",
        "mandarin", "olives", "pickles", "jelly", "jam", "preserves", "jar",
    ]),
    ("Breakfast Foods", [
        "cereal", "granola", "oatmeal", "oats", "breakfast", "toast", "toaster pastry", "bars",
    ]),
    ("Grains & Pasta", [
        "pasta", "rice", "quinoa", "noodles", "grain", "grains", "fussili", "spaghetti", "macaroni",
    ]),
    ("Baking Supplies", [
        "flour", "baking", "yeast", "baking powder", "baking soda", "icing", "frosting", "cake mix", "brownie mix", "cornmeal",
        "breadcrumbs", "bread crumbs",
    ]),
    ("Oils, Vinegars & Dressings", [
        "oil", "olive oil", "canola oil", "vinegar", "dressing", "balsamic", "avocado oil", "sesame oil",
    ]),
    ("Produce (Packaged & Dried)", [
        "dried fruit", "raisins", "dates", "nori", "seaweed", "dehydrated", "freeze-dried", "gooseberry", "amla",
    ]),
    ("Meat & Seafood (Shelf-Stable)", [
        "tuna", "sardine", "salmon", "anchovy", "jerky", "meat", "chicken", "shrimp", "fish", "pate",
    ]),
    ("Health & Wellness Foods", [
        "protein", "keto", "vitamin", "supplement", "wellness", "minoxidil", "rogaine", "omega", "collagen", "electrolyte",
    ]),
    ("Baby Food", [
        "baby food", "infant", "toddler", "lil' bits", "puffs",
    ]),
    ("Frozen Foods", [
        "frozen",
    ]),
    ("International & Gourmet Foods", [
        "imported", "gourmet", "italian", "mexican", "thai", "indian", "japanese", "korean", "international",
    ]),
    ("Canned & Packaged Goods", [
        "mason jar", "wide mouth", "capsules", "toothpaste", "mouthwash", "soap", "sunscreen",
    ]),
    ("Canned & Packaged Goods", [
        "pet food", "dog food", "cat food", "treats",
    ]),
]

# Units to grams and millilitres, one profile for stated totals and one for value-unit pairs; they differ in the fluid ounce.
TOTAL_MASS = {"oz": 28.35, "ounce": 28.35, "lb": 453.59, "pound": 453.59, "g": 1.0, "gram": 1.0, "kg": 1000.0}
TOTAL_VOLUME = {"fl oz": 29.5735, "ml": 1.0, "l": 1000.0, "liter": 1000.0}
TOTAL_COUNT = [
    "ct", "count", "pcs", "pack",
]
PAIR_UNITS = [("oz|ounce|ounces", 28.35, 0.0), ("lb|pound|pounds", 453.59, 0.0), ("g|gram|grams", 1.0, 0.0), (r"fl\s*oz|floz", 0.0, 29.57),
    ("ml|milliliter|millilitre|milliliters|millilitres", 0.0, 1.0)]

# Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "twenty": 20}

# Nouns that end a brand, second words that a brand may have, titles, articles, and words trimmed from a brand's end.
PRODUCT_NOUNS = [
    "sauce", "taco", "salsa", "chips", "cracker", "crackers", "cereal", "candy", "chocolate", "coffee", "tea", "oats", "oatmeal", "pasta",
    "rice", "beans", "juice", "soup", "oil", "vinegar", "salt", "pepper", "seasoning", "spice", "spices", "flour", "sugar", "water",
    "soda", "milk", "yogurt", "cheese", "bread", "bar", "bars", "shampoo", "conditioner", "soap", "detergent", "lotion", "cream",
    "toothpaste", "toothbrush", "cleaner", "wipes", "deodorant", "spray",
]
BRAND_SECONDS = [
    "creek", "valley", "farms", "farm", "grove", "gardens", "garden", "mills", "market", "roasters", "brew", "brewing", "brewery",
    "house", "river", "mountain", "mountains", "coffee", "tea", "foods", "organics", "kitchen", "kitchens", "country", "company", "co",
]
HONORIFICS = [
    "mr", "mrs", "ms", "dr", "st", "saint",
]
ARTICLES = [
    "la", "le", "el", "los", "las", "the", "a", "an", "de", "del", "da", "di",
]
BRAND_TAILS = [
    "company", "co", "inc", "incorporated", "ltd", "limited", "llc", "corp", "corporation", "brand", "brands", "products", "product",
    "country", "kitchen", "kitchens", "food", "foods", "market", "markets",
]

# Words that end a rule brand, units, ingredients, and audiences.
RULE_STOPS = [
    "sauce", "salsa", "dressing", "marinade", "dip", "spread", "soup", "stew", "chili", "broth", "stock", "bowl", "salt", "pepper",
    "spice", "seasoning", "herb", "bouillon", "rub", "powder", "blend", "chip", "chips", "crisps", "cracker", "crackers", "pretzel",
    "pretzels", "cookie", "cookies", "snack", "snacks", "cereal", "granola", "oats", "oatmeal", "bar", "bars", "candy", "chocolate",
    "gummies", "gummi", "sweets", "coffee", "tea", "drink", "beverage", "juice", "soda", "water", "gooseberry", "amla", "pasta",
    "noodles", "rice", "beans", "grains", "fruit", "nuts", "mix", "trail", "tuna", "shrimp", "fish", "jerky", "oil", "vinegar", "syrup",
    "honey", "flour", "sugar", "baking", "cheese", "butter", "milk", "yogurt", "pickle", "pickles", "organic", "natural", "premium",
    "gourmet", "original", "classic", "mild", "medium", "hot", "spicy", "sweet", "tangy", "zesty", "chatpata", "hearty", "creamy",
    "chunky", "smooth", "crispy", "crunchy", "fine", "coarse", "ground", "whole", "sliced", "diced", "black", "white", "red", "pink",
    "green", "golden", "yellow", "light", "lite", "diet", "low", "reduced", "zero", "plus", "max", "ultra", "extra", "super", "thirst",
    "quencher", "energy", "sport", "sports", "chunk", "solid", "albacore",
]
RULE_UNITS = [
    "oz", "ounce", "ounces", "ml", "g", "gram", "grams", "kg", "lb", "pound", "fl", "floz", "fl-oz", "liter", "litre", "l",
]
RULE_INGREDIENTS = [
    "onion", "garlic", "paprika", "turmeric", "cumin", "coriander", "ginger", "cinnamon", "oregano", "basil", "thyme", "rosemary",
    "peppercorn", "pumpkin", "chamomile", "cheesecake",
]
AUDIENCES = [
    "women", "women's", "mens", "men's", "kids", "children", "baby",
]

# What is no brand.
BAD_BRANDS = [
    r"^brand\s*$",
    r"^pack[_ ]?count\s*[,:]*$",
    r"^mass[_ ]?g\s*[,:]*$",
    r"^volume[_ ]?ml\s*[,:]*$",
    r"^keywords\s*[,:]*$",
    r"^category\s*[,:]*$",
    r"^pack\s*[,:]*$",
    r"^<.*>$",
    r"^\d+$",
    r"^float\s*$",
    r"^str\s*$",
    r"^unknown\s*[,:]*$",
    r"^[.]+$",
    r"^[-]+$",
    r"^[,]+$",
    r"^pack[_ ]count.*mass[_ ]g",
    r"^mass[_ ]g.*volume",
    r"^keywords.*category",
]
BAD_WORDS = [
    "pack", "packs", "case", "cases", "count", "box", "boxes", "bag", "bags", "bottle", "bottles", "jar", "jars", "can", "cans", "wood",
    "organic", "raw", "natural", "premium", "fresh", "classic", "original",
]
FIELD_NAMES = [
    "pack_count", "mass_g", "volume_ml", "keywords", "category",
]

# What follows a brand by mistake (a field's name and its sign), signs between words, possessives, and white space.
BRAND_LEAK = r"(?i)\s*(?:pack[_ ]?count|mass[_ ]?g|volume[_ ]?ml|keywords|category)\s*[:|-].*$"
CAMEL = "(?<=[a-z])(?=[A-Z])"
CAMEL_WORD = "([A-Za-z])([A-Z][a-z])"
BRAND_LENGTH = 64
POSSESSIVE = r"\b([a-z0-9]+)'s\b"
PLURAL_POSSESSIVE = r"\b([a-z0-9]+)s'\b"
SIGNS = r"[^\w\s]"
BLANKS = r"\s+"
