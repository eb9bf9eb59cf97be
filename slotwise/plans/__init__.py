"""Reports over the case table; each is a function from DataFrame to DataFrame."""
