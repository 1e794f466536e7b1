"""Product category groupings.

The groupings are applied to the product table (once per product) before it is
joined to items. Each group becomes one hashed set-membership test.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelsight.functions.expressions import col

OTHERS = "Others"

# Raw categories of each main category.
MAIN_CATEGORIES = {
    "Home & Living": [
        "bed_bath_table", "furniture_decor", "housewares", "office_furniture", "home_confort",
        "home_comfort_2", "furniture_living_room", "furniture_bedroom",
        "furniture_mattress_and_upholstery", "home_appliances", "home_appliances_2",
        "small_appliances", "small_appliances_home_oven_and_coffee", "air_conditioning",
        "kitchen_dining_laundry_garden_furniture", "la_cuisine",
    ],
    "Health & Beauty & Fashion": [
        "health_beauty", "perfumery", "diapers_and_hygiene", "watches_gifts",
        "fashion_bags_accessories", "luggage_accessories", "fashion_shoes",
        "fashion_underwear_beach", "fashion_male_clothing", "fashio_female_clothing",
        "fashion_sport", "fashion_childrens_clothes",
    ],
    "Electronics & Tech": [
        "computers_accessories", "computers", "tablets_printing_image", "telephony",
        "fixed_telephony", "electronics", "audio", "cine_photo",
    ],
    "Leisure & Kids": [
        "toys", "baby", "sports_leisure", "books_general_interest", "books_technical",
        "books_imported", "consoles_games", "dvds_blu_ray", "music", "cds_dvds_musicals", "art",
        "arts_and_craftmanship", "cool_stuff", "party_supplies", "christmas_supplies",
    ],
    "DIY & Industry": [
        "garden_tools", "costruction_tools_garden", "flowers", "agro_industry_and_commerce",
        "construction_tools_construction", "home_construction", "construction_tools_lights",
        "construction_tools_safety", "costruction_tools_tools", "signaling_and_security",
        "industry_commerce_and_business", "stationery",
    ],
    "Others": [
        "auto", "food", "food_drink", "drinks", "pet_shop", "market_place",
        "security_and_services",
    ],
}

# Raw categories of each sub category.
SUB_CATEGORIES = {
    "Furniture & Decor": [
        "bed_bath_table", "furniture_decor", "office_furniture", "furniture_living_room",
        "furniture_bedroom", "furniture_mattress_and_upholstery",
    ],
    "Kitchen & Housewares": ["housewares", "la_cuisine", "kitchen_dining_laundry_garden_furniture"],
    "Home Appliances": [
        "home_appliances", "home_appliances_2", "small_appliances",
        "small_appliances_home_oven_and_coffee", "air_conditioning",
    ],
    "Home Interior": ["home_confort", "home_comfort_2"],
    "Health & Beauty": ["health_beauty", "perfumery", "diapers_and_hygiene"],
    "Fashion Accessories": ["watches_gifts", "fashion_bags_accessories", "luggage_accessories"],
    "Clothing & Shoes": [
        "fashion_shoes", "fashion_underwear_beach", "fashion_male_clothing",
        "fashio_female_clothing", "fashion_sport", "fashion_childrens_clothes",
    ],
    "IT & Computers": ["computers_accessories", "computers", "tablets_printing_image"],
    "Telephony": ["telephony", "fixed_telephony"],
    "Electronics": ["electronics", "audio", "cine_photo"],
    "Kids & Baby": ["toys", "baby"],
    "Sports & Leisure": ["sports_leisure"],
    "Books & Media": [
        "books_general_interest", "books_technical", "books_imported", "dvds_blu_ray", "music",
        "cds_dvds_musicals",
    ],
    "Games & Hobbies": [
        "consoles_games", "art", "arts_and_craftmanship", "cool_stuff", "party_supplies",
        "christmas_supplies",
    ],
    "Garden & Agro": [
        "garden_tools", "costruction_tools_garden", "flowers", "agro_industry_and_commerce",
    ],
    "Tools & Construction": [
        "construction_tools_construction", "home_construction", "construction_tools_lights",
        "construction_tools_safety", "costruction_tools_tools", "signaling_and_security",
    ],
    "Industry & Office": ["industry_commerce_and_business", "stationery"],
    "Automotive": ["auto"],
    "Food & Drink": ["food", "food_drink", "drinks"],
    "Pet Shop": ["pet_shop"],
    "Others": ["market_place", "security_and_services"],
}

# Names of the historical grouping; it holds the main-category sets.
HISTORICAL_GROUPS = {
    "Home & Living": "home_living",
    "Health & Beauty & Fashion": "personalcare_fashion",
    "Electronics & Tech": "electronics_tech",
    "Leisure & Kids": "hobbies_leisure_kids",
    "DIY & Industry": "diy_garden_industry",
    "Others": "automotivie_food",
}


def _group_of(category: str | Column, groups: dict[str, list[str]], default: str | None) -> Column:
    category = col(category)
    out = F.when(category.isNull(), F.lit(default))
    for name, members in groups.items():
        out = out.when(category.isin(*members), F.lit(name))
    return out.otherwise(F.lit(default))


def main_category(category: str | Column) -> Column:
    """One of six groups; unknown and missing categories count as Others."""
    return _group_of(category, MAIN_CATEGORIES, OTHERS)


def sub_category(category: str | Column) -> Column:
    return _group_of(category, SUB_CATEGORIES, OTHERS)


def historical_group(category: str | Column) -> Column:
    """The older grouping, which leaves unknown categories missing."""
    groups = {HISTORICAL_GROUPS[name]: members for name, members in MAIN_CATEGORIES.items()}
    return _group_of(category, groups, None)


def known_categories() -> list[str]:
    return sorted(c for members in MAIN_CATEGORIES.values() for c in members)
