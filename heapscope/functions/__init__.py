"""heapscope.functions"""
