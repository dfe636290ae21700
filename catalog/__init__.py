"""The library's operators as queries over star-schema tables, with SQL to check them."""
