"""Values the shop's behaviour depends on, as the reference fixes them."""

# These must equal the reference's.
SOLD_STATUSES = ("PAID", "SHIPPED", "DELIVERED")   # order statuses counted as sales (compared upper-cased)
PAID_STATUS = "paid"                                # status a successful checkout ends in
SALES_DEFAULT_START = "2025-01-01"                  # sales report range when no dates are given
SALES_DEFAULT_END = "2025-12-31"
PRODUCT_PAGE_SIZE = 5                               # products on the plain product page
POPULAR_LIST_SIZE = 10                              # variants on the popular list
CATALOG_GENDER = "MEN"                              # gender of the catalog list
TAG_NEW, TAG_SALE, TAG_LIFESTYLE, TAG_SLIPON = "new", "sale", "lifestyle", "slipon"
BADGE_LIFESTYLE, BADGE_SLIP = "LIFESTYLE", "SLIP"   # badge substrings behind the last two tags
RECOMMENDED_SOLD_OVER = 1000                        # sold count above which a product is recommended
RATING_MIN, RATING_MAX = 1, 5
ADMIN_ROLE_REQUEST = "admin"                        # the only requested role that grants admin
ROLE_ADMIN, ROLE_USER = "ADMIN", "USER"             # stored role values
