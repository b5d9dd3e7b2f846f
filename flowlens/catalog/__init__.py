"""Every operator as a query over the sample tables, with the SQL it must agree with."""
