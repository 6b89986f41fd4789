"""Reading and writing tables, with the checks that go with them."""
