"""Column functions: what one value becomes. All run in generated code unless their docstring says otherwise."""
